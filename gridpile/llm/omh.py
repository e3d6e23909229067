"""Near-duplicate texts by Order MinHash: candidates share a sketch that keeps the text order of minimal k-mers, banded alignment decides.

Work is done in waves, each of which only compares texts that the waves before have not put into one class. So a group of
thousands of near copies is joined once, through a few of its members, and costs the later waves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, mix, shingle_hashes, small_batches, stored, text_or_empty, word_hashes
from .components import components

SIMILARITY = 0.8
SHINGLE = 5


@dataclass(frozen=True)
class Level:
    """Sketches of texts of low to high words: so many, each of the ell least k-mers of k words in text order."""

    k: int
    ell: int
    sketches: int
    low: int
    high: int


#: Five-word k-mers, and three-word ones, as an edit in every fifth word leaves no five words together; shorter ones for short
#: texts. Of pairs of likeness 0.8 0.98 and more share a sketch where edits are at random places, 0.93 and more where they are in
#: every fifth word. The ranges overlap, so that two texts of near length always have a level in common.
LEVELS = (Level(1, 4, 64, 0, 10), Level(2, 3, 64, 8, 40), Level(3, 2, 64, 32, 1 << 62), Level(SHINGLE, 2, 64, 32, 1 << 62))
#: Longer texts have a level's 64 sketches from 4 permutations of 16 bins, or from one of 64 (low, high, permutations).
BINNED = ((320, 1600, 4), (1280, 1 << 62, 1))
#: Sketches of whole texts by single words, for the members of large buckets alone: a passage that many share hardly counts.
WORDS = (Level(1, 4, 64, 0, 40), Level(1, 8, 96, 32, 1 << 62))
#: The first wave has so many sketches of each text.
FIRST = 16
#: Texts of a bucket of up to SMALL are compared pair by pair, of a larger one with one text first.
SMALL = 8
BLOCK = 256
#: Cells of a text's word counts, which tell that two texts have too few words in common.
CELLS = 1024
#: Bits of the mask of keys that large buckets left open, as a power of two; it is of this size whatever their number.
MASK = 22


def labelled(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence number in the row: the second of two equal k-mers differs from the first."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.arange(len(h))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix(h + occurrence * np.uint64(0x9E3779B97F4A7C15))


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    p = int(differ[0]) if len(differ) else n
    a, b = a[p:], b[p:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    q = n - 1 - int(differ[-1]) if len(differ) else n
    return a[: len(a) - q], b[: len(b) - q]


def _common_words(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    v = both[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    in_a = np.add.reduceat((order < len(a)).astype(np.int64), first)
    return int(np.minimum(in_a, np.diff(np.append(first, len(v))) - in_a).sum())


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance of a and b if it is at most most, else None.

    The alignment stays in the band of diagonals that `most` edits can reach. A column of the band is four bit vectors (steps
    down and along the table, plus and minus one), so all of its cells are computed together; the cell on the last diagonal
    counts the edits, which never decrease along it.
    """
    a, b = _trim(a, b)
    if len(a) < len(b):
        a, b = b, a
    la, lb = len(a), len(b)
    if la - lb > most:
        return None
    if not lb:
        return la
    if la - _common_words(a, b) > most:  # too few common words in whatever order
        return None
    below = (most - (la - lb)) // 2
    width = la - lb + 2 * below + 1
    full, last = (1 << width) - 1, 1 << (below + la - lb)
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << (i + below)
    edits = la - lb
    up, down = full >> below << below, 0
    for j, w in enumerate(b.tolist()):
        same = places.get(w, 0) >> j & full
        level = (((same & up) + up) ^ up | same | down) & full
        plus, minus = down | full & ~(level | up), level & up
        if not level & last:
            edits += 1
            if edits > most:
                return None
        level >>= 1
        up, down = minus | full & ~(level | plus), level & plus
    return edits


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float | None:
    """1 - distance / length of the longer text, if that is at least similarity."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    d = banded_distance(a, b, int((1 - similarity) * longer + 1e-9))
    return None if d is None else 1 - d / longer


def _some(h: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of h that belong to some rows, and their offsets."""
    counts = np.diff(offsets)[rows]
    new = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return h[np.arange(new[-1]) + np.repeat(offsets[:-1][rows] - new[:-1], counts)], new


def _seed(s: int, level: Level) -> np.uint64:
    return mix(np.full(1, s + 1 + (level.k << 20) + (level.ell << 28), np.uint64))[0]


def order_min_hash(h: np.ndarray, offsets: np.ndarray, level: Level, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows with k-mers, and sketches first to last of each: a hash of the ell least labelled k-mers (all, if fewer) in text order."""
    last = level.sketches if last is None else min(last, level.sketches)
    counts = np.diff(offsets)
    rows = np.flatnonzero(counts)
    starts, counts = offsets[:-1][rows], counts[rows]
    out = np.zeros((len(rows), max(0, last - first)), np.uint64)
    if not len(rows):
        return rows, out
    lab = labelled(h, offsets)
    place = np.arange(len(h), dtype=np.uint64)
    low_bits = np.uint64((1 << max(1, int(len(h)).bit_length())) - 1)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(first, last):
        seed = _seed(s, level)
        v = (lab ^ seed) * (seed | np.uint64(1))
        v &= ~low_bits  # the least value also tells its place
        v |= place
        picks: list[np.ndarray] = []
        for i in range(level.ell):
            at = (np.minimum.reduceat(v, starts) & low_bits).astype(np.int64)
            if picks:
                at = np.where(counts > i, at, picks[-1])
            picks.append(at)
            v[at] = top
        out[:, s - first] = seed
        for at in np.sort(np.stack(picks), axis=0):
            out[:, s - first] = mix(out[:, s - first] * np.uint64(3) + lab[at])
    return rows, out


def binned_order_min_hash(lab: np.ndarray, permutations: int, level: Level, first: int = 0, last: int | None = None) -> np.ndarray:
    """As order_min_hash for one long text of labelled k-mers: each permutation gives a sketch for each of its bins of hash values; 0 for an empty bin."""
    last = level.sketches if last is None else min(last, level.sketches)
    bins = level.sketches // permutations
    out = np.zeros(level.sketches, np.uint64)
    for p in range(first // bins, -(-last // bins)):
        seed = _seed((permutations << 12) + p, level)
        v = (lab ^ seed) * (seed | np.uint64(1))
        order = np.argsort(v)
        own = v[order] >> np.uint64(64 - (bins.bit_length() - 1))
        begin = np.searchsorted(own, np.arange(bins, dtype=np.uint64))
        size = np.diff(np.append(begin, len(own)))
        has = np.flatnonzero(size)
        picks = np.stack([order[begin[has] + np.minimum(i, size[has] - 1)] for i in range(level.ell)])
        made = np.full(len(has), seed, np.uint64)
        for at in np.sort(picks, axis=0):
            made = mix(made * np.uint64(3) + lab[at])
        out[p * bins + has] = mix(made + has.astype(np.uint64))
    return out[first:last]


def sketch_rows(words: np.ndarray, offsets: np.ndarray, levels: tuple[Level, ...] = LEVELS, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of sketches first to last of every level that a row of word hashes belongs to."""
    n = np.diff(offsets)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for level in levels:
        rows = np.flatnonzero((n >= max(1, level.low)) & (n <= level.high))
        plain = rows[n[rows] < BINNED[0][0] * 5 // 4] if level.k > 2 else rows
        if len(plain):
            have, made = order_min_hash(*shingle_hashes(*_some(words, offsets, plain), level.k), level, first, last)
            found.append((np.repeat(plain[have], made.shape[1]), made.ravel()))
        for low, high, permutations in BINNED if level.k > 2 else ():
            for r in rows[(n[rows] >= low) & (n[rows] < high)].tolist():
                one = np.array([0, n[r]])
                h, o = shingle_hashes(words[offsets[r] : offsets[r + 1]], one, level.k)
                made = binned_order_min_hash(labelled(h, o), permutations, level, first, last)
                made = made[made != 0]
                found.append((np.full(len(made), r), made))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches of at most about 1 MB of text, or one row, with their word hashes."""
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            sizes = np.cumsum(pa.compute.binary_length(whole.column(column).slice(at, 4096)).fill_null(0).to_numpy(zero_copy_only=False))
            part = whole.slice(at, max(1, int(np.searchsorted(sizes, 1 << 20))))
            at += part.num_rows
            yield part, *word_hashes(part.column(column), lower=True)


_MANY = 32
_MEETS = 33


def _profiles(words: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """How many words of each row fall in each of CELLS cells; empty where a count would not fit."""
    out = []
    for r in range(len(offsets) - 1):
        c = np.bincount((words[offsets[r] : offsets[r + 1]] >> np.uint64(54)).astype(np.int64), minlength=CELLS)
        out.append(c.astype(np.uint16).tobytes() if c.max() < 1 << 16 else b"")
    return out


def _common_at_most(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For every two of a and b at most how many words they have in common."""
    out = np.full((len(a), len(b)), np.iinfo(np.int64).max)
    one, two = (np.flatnonzero([len(x) > 0 for x in s]) for s in (a, b))
    if len(one) and len(two):
        other = np.stack([np.frombuffer(b[j], np.uint16) for j in two])
        for i in one:
            out[i, two] = np.minimum(np.frombuffer(a[i], np.uint16), other).sum(1, dtype=np.int64)
    return out


def _mask(keys: DataFrame) -> np.ndarray:
    """A bit for the first MASK bits of each key; at most 2**MASK / 64 numbers reach the driver, however many keys there are."""
    bit = F.expr(f"cast(shiftrightunsigned(key, {64 - MASK}) & 63 as int)")
    words = keys.groupBy(F.expr(f"cast(shiftrightunsigned(key, {64 - MASK + 6}) as int)").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    out = np.zeros(1 << (MASK - 6), np.int64)
    for r in words.collect():
        out[r.at] = r.bits
    return out.view(np.uint64)


def _may_hold(mask: np.ndarray, key: np.ndarray) -> np.ndarray:
    top = key >> np.uint64(64 - MASK)
    return (mask[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)


def _entries(texts: DataFrame, levels: tuple[Level, ...], first: int, last: int | None, gather: bool, profiles: bool = False, mask: np.ndarray | None = None) -> DataFrame:
    """(key, doc_id, comp, info) for the sketches of texts (doc_id, text, comp, meets). info: meets, whether the row stands for several, words.

    gather: of the texts of a batch that have one class and share a key, the one that meets most stands for all; so the many
    copies of a text, already in one class, do not meet again in one task. mask: only of keys that it may hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, offsets in _slices(batches, 1):
            row, key = sketch_rows(words, offsets, levels, first, last)
            if mask is not None:
                wanted = _may_hold(mask, key)
                row, key = row[wanted], key[wanted]
            doc, comp, meets = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            info = (np.minimum(meets, (1 << 30) - 1) << _MEETS) | np.diff(offsets)
            if gather:
                _, name, size = np.unique(comp, return_inverse=True, return_counts=True)
                shared = size[name][row] > 1
                many = np.flatnonzero(shared)
                order = many[np.lexsort((-info[row[many]], comp[row[many]], key[many]))]
                new = np.ones(len(order), bool)
                new[1:] = (key[order[1:]] != key[order[:-1]]) | (comp[row[order[1:]]] != comp[row[order[:-1]]])
                first_of = np.flatnonzero(new)
                several = np.diff(np.append(first_of, len(order))) > 1
                keep = np.concatenate([np.flatnonzero(~shared), order[first_of]])
                bit = np.concatenate([np.zeros(int((~shared).sum()), np.int64), several.astype(np.int64) << _MANY])
            else:
                keep, bit = np.arange(len(row)), np.zeros(len(row), np.int64)
            made = [pa.array(key[keep].view(np.int64)), pa.array(doc[row[keep]]), pa.array(comp[row[keep]]), pa.array(info[row[keep]] | bit)]
            if not profiles:
                yield pa.RecordBatch.from_arrays(made, ["key", "doc_id", "comp", "info"])
                continue
            own = pa.array(_profiles(words, offsets), pa.binary())
            for i in range(0, len(keep), 2048):
                yield pa.RecordBatch.from_arrays([*[m.slice(i, 2048) for m in made], own.take(pa.array(row[keep[i : i + 2048]]))], ["key", "doc_id", "comp", "info", "profile"])

    schema = "key bigint, doc_id bigint, comp bigint, info bigint"
    return texts.select("doc_id", "text", "comp", "meets").mapInArrow(run, f"{schema}, profile binary" if profiles else schema)


def _near(one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(one, two) >= similarity * np.maximum(one, two) - 1e-6


def _met(parts: list[list[np.ndarray]], similarity: float) -> pa.RecordBatch:
    out = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)] + [np.zeros(0, np.int64)] * 3
    a, b, ca, cb, large, na, nb, key = out
    words = np.int64((1 << _MANY) - 1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), np.where(a < b, ca, cb), np.where(a < b, cb, ca), large, _near(na & words, nb & words, similarity), key)], ["a", "b", "ca", "cb", "large", "near", "key"])


_MET = "a bigint, b bigint, ca bigint, cb bigint, large boolean, near boolean, key bigint"


def _across(entries: DataFrame, similarity: float, keyed: bool = False) -> DataFrame:
    """(a, b, ca, cb, large, near, key) for texts of different classes that share a key, near in length or not. key: that of a
    large bucket with keyed, else 0, so that two texts are one row.

    In a small bucket all such pairs; in a large one, or where a row stands for several texts, the text that meets most with each
    of another class. Buckets are read as a sorted stream, of which a task keeps at most a batch and SMALL rows.
    """

    def pairs(k: np.ndarray, doc: np.ndarray, comp: np.ndarray, info: np.ndarray, first: np.ndarray, open_group: bool) -> Iterator[list[np.ndarray]]:
        """Of whole groups; or, with open_group, of a first row and further rows of its group, which is large."""
        size = np.diff(np.append(first, len(k)))
        whole = np.maximum.reduceat(((info >> _MANY) & 1), first) == 0
        small = np.repeat((size <= SMALL) & whole, size) if not open_group else np.zeros(len(k), bool)
        for d in range(1, SMALL):
            i = np.flatnonzero(small[:-d] & (k[d:] == k[:-d]) & (comp[d:] != comp[:-d])) if len(k) > d else np.zeros(0, np.int64)
            if len(i):
                yield [doc[i], doc[i + d], comp[i], comp[i + d], np.zeros(len(i), bool), info[i], info[i + d], np.zeros(len(i), np.int64)]
        head = np.repeat(first, size)
        i = np.flatnonzero(~small & (comp != comp[head]))
        if len(i):
            h = head[i]
            yield [doc[h], doc[i], comp[h], comp[i], np.ones(len(i), bool), info[h], info[i], k[i] if keyed else np.zeros(len(i), np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        streaming = False  # held is the first row of a large group, whose rows so far are done
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(i).to_numpy() for i in range(4)]
            at = [np.concatenate(x) for x in zip(held, new, strict=True)] if held is not None else new
            first = np.flatnonzero(np.concatenate([[True], at[0][1:] != at[0][:-1]]))
            made: list[list[np.ndarray]] = []
            begin = 0
            if streaming:
                begin = int(first[1]) if len(first) > 1 else len(at[0])
                made += pairs(*[x[:begin] for x in at], np.zeros(1, np.int64), True)
                first = first[1:] - begin
                if not len(first):
                    held = [x[:1] for x in at]
                    yield _met(made, similarity)
                    continue
                at, streaming = [x[begin:] for x in at], False
            cut = int(first[-1])
            if cut:
                made += pairs(*[x[:cut] for x in at], first[:-1], False)
            held = [x[cut:] for x in at]
            if len(held[0]) > SMALL:
                made += pairs(*held, np.zeros(1, np.int64), True)
                held, streaming = [x[:1] for x in held], True
            yield _met(made, similarity)
        if held is not None and not streaming:
            yield _met(list(pairs(*held, np.zeros(1, np.int64), False)), similarity)

    dealt = entries.repartition("key").sortWithinPartitions("key", F.desc("info"), "doc_id")
    return dealt.mapInArrow(run, _MET).distinct()


def _every(entries: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b, ca, cb) of different classes that share a key and may have enough words in common, by their profiles.

    Buckets are cut into blocks of about BLOCK, and every two blocks are a group of their own: the work grows with the square
    of a bucket, in groups of bounded size, and only pairs that profiles cannot tell apart leave them.
    """
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d")
    placed = entries.join(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "comp", "info", "profile")
    words = np.int64((1 << _MANY) - 1)

    def pairs(x: list) -> Iterator[list[np.ndarray]]:
        """Of whole groups, whose rows of one block stand together."""
        first = np.flatnonzero(np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]) | (x[2][1:] != x[2][:-1])]))
        for f, to in zip(first, np.append(first[1:], len(x[0])), strict=True):
            block, doc, comp, n = x[3][f:to], x[4][f:to], x[5][f:to], x[6][f:to] & words
            both = (comp[:, None] != comp[None]) & ((x[1][f] == x[2][f]) | (block[:, None] != block[None]))
            both &= _near(n[:, None], n[None], similarity)
            both = np.triu(both, 1)
            if both.any():
                both &= _common_at_most(x[7][f:to], x[7][f:to]) >= similarity * np.maximum(n[:, None], n[None]) - 1e-6
            r, c = np.nonzero(both)
            yield [doc[r], doc[c], comp[r], comp[c], np.zeros(len(r), bool), n[r], n[c], np.zeros(len(r), np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [*[b.column(i).to_numpy() for i in range(7)], b.column(7).to_pylist()]
            held = [*[np.concatenate(y) for y in zip(held[:7], new[:7], strict=True)], held[7] + new[7]] if held is not None else new
            differ = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            cut = int(differ[-1]) + 1 if len(differ) else 0
            if cut:
                yield _met(list(pairs([y[:cut] for y in held])), similarity)
                held = [y[cut:] for y in held]
        if held is not None:
            yield _met(list(pairs(held)), similarity)

    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")
    return dealt.mapInArrow(run, _MET).where("near").select("a", "b", "ca", "cb").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b, ca, cb) that align, with their likeness. Texts (doc_id, text) go on as 32-bit hashes of their words."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = texts.select("doc_id", "text").join(broadcast_if_small(ids, 1_000_000), "doc_id", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, offsets in _slices(batches, 1):
            small = (words >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([small[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())], ["doc_id", "words"])

    words = stored(texts.mapInArrow(hashed, "doc_id bigint, words binary"), "omh-words")
    both = pairs.join(words.select(F.col("doc_id").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("doc_id").alias("b"), F.col("words").alias("wb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            of = [alike(np.frombuffer(u, np.uint32), np.frombuffer(v, np.uint32), similarity) for u, v in zip(x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True)]
            kept = pa.array([i for i, s in enumerate(of) if s is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([*[x.column(i).take(kept) for i in range(4)], pa.array([s for s in of if s is not None], pa.float64())], ["a", "b", "ca", "cb", "likeness"])

    return stored(both.select("a", "b", "ca", "cb", "wa", "wb").mapInArrow(run, "a bigint, b bigint, ca bigint, cb bigint, likeness double").dropDuplicates(["a", "b"]), "omh-links")


def _first_wave(texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links by the first sketches, and (doc_id, meets) of the members of large buckets: the sum of their buckets' sizes.

    The text that meets most, the original of many copies rather than one of them, is what a large bucket's others are compared with.
    """
    entries = stored(_entries(texts, LEVELS, 0, FIRST, False), "omh-first")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(entries.join(sizes, "key").select("key", "doc_id", F.col("info").bitwiseAND((1 << _MANY) - 1).alias("n_words"), "n"), "omh-members")
    near = F.least("wa", "wb") >= similarity * F.greatest("wa", "wb") - 1e-6
    side = lambda x, y: members.where(F.col("n") <= SMALL).select("key", F.col("doc_id").alias(x), F.col("n_words").alias(y))
    pairs = side("a", "wa").join(side("b", "wb"), "key").where((F.col("a") < F.col("b")) & near).select("a", "b")
    large = members.where(F.col("n") > SMALL)
    meets = stored(large.groupBy("doc_id").agg(F.sum("n").alias("meets")), "omh-meets")
    large = large.join(broadcast_if_small(meets, 1_000_000), "doc_id")
    middle = large.groupBy("key").agg(F.max(F.struct("meets", "doc_id", "n_words")).alias("m")).select("key", F.col("m.doc_id").alias("c"), F.col("m.n_words").alias("wb"))
    star = large.join(middle, "key").where("doc_id <> c").withColumnRenamed("n_words", "wa").where(near).select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b"))
    pairs = stored(pairs.union(star).distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "omh-pairs")
    return _verify(pairs, texts, similarity), meets


def _merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after links between classes (ca, cb) of texts; without links, the classes as they were."""
    if classes is not None and links.isEmpty():
        return classes
    now = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if classes is None:
        return stored(now, "omh-classes")
    now = stored(now, "omh-joined")
    moved = classes.join(broadcast_if_small(now.select(F.col("node").alias("component"), F.col("component").alias("to")), 1_000_000), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(moved.unionByName(now.join(classes, "node", "left_anti")), "omh-classes")


def near_classes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of all texts (doc_id, text) that alike ones tie together; texts of the same doc_id are one node.

    Two texts that share a sketch are compared, unless they are in one class already: after FIRST sketches of each text classes
    are formed, and then texts of different classes meet in the buckets of all other sketches. Where a large bucket holds
    texts of other classes that do not align with the one compared, all texts of those classes, linked ones too, get sketches of
    single words over the whole text, in which a passage that many share hardly counts. The buckets of those that are large and
    hold texts that do not align are compared pair by pair, in blocks; smaller ones have been, and in other large ones all are of
    one class.
    """
    plain = texts.withColumns({"comp": F.col("doc_id"), "meets": F.lit(0).cast("bigint")})
    links, meets = _first_wave(plain, similarity)
    classes = _merged(None, links)

    def with_classes(some: DataFrame | None = None) -> DataFrame:
        """Texts with their classes; only those of the doc_ids in some, if given."""
        label = classes.withColumnRenamed("node", "doc_id").join(meets, "doc_id", "full")
        label = broadcast_if_small(stored(label.select("doc_id", F.coalesce("component", "doc_id").alias("c"), F.coalesce("meets", F.lit(0)).alias("m")), "omh-labels"), 1_000_000)
        rows = texts if some is None else texts.join(broadcast_if_small(some, 1_000_000), "doc_id", "left_semi")
        return rows.join(label, "doc_id", "left").select("doc_id", "text", F.coalesce("c", "doc_id").alias("comp"), F.coalesce("m", F.lit(0)).cast("bigint").alias("meets"))

    def wave(entries: DataFrame, keyed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Links across classes, the doc_ids of the classes that met in a large bucket without aligning there, and pairs that did."""
        met = stored(_across(entries, similarity, keyed), "omh-met")
        links = _verify(met.where("near").select("a", "b", "ca", "cb").distinct(), texts, similarity)
        loose = met.where("large").join(links.select("a", "b"), ["a", "b"], "left_anti")
        comps = loose.select(F.explode(F.array("ca", "cb")).alias("component")).distinct()
        comps = stored(comps, "omh-open")
        inside = classes.join(broadcast_if_small(comps, 1_000_000), "component", "left_semi").select("node")
        return links, stored(inside.union(comps).toDF("doc_id").distinct(), "omh-hot"), loose

    links, hot, _ = wave(_entries(with_classes(), LEVELS, FIRST, None, True))
    classes = _merged(classes, links)
    if not hot.isEmpty():
        links, hot, loose = wave(_entries(with_classes(hot), WORDS, 0, None, True), True)
        classes = _merged(classes, links)
        if not hot.isEmpty():
            keys = stored(loose.select("key").distinct(), "omh-keys")
            entries = _entries(with_classes(hot), WORDS, 0, None, False, True, _mask(keys)).join(broadcast_if_small(keys, 1_000_000), "key", "left_semi")
            pairs = stored(_every(entries, similarity), "omh-pairs")
            classes = _merged(classes, _verify(pairs, texts, similarity))
    return classes


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of documents: doc_id, class_id, kept.

    Rows of equal text are one text. Texts of similarity (1 - word edits / words of the longer) of at least `similarity`, itself
    at least 0.8, that share a sketch are tied, and a class is what ties reach; class_id is its smallest doc_id, kept says
    whether the row has it. Links inside a class are not counted: that would take every two members of each large group. Case
    of A-Z and kinds of white space do not count as edits. Null texts equal empty ones. Texts without words are alike only if
    equal. Rows with one doc_id are one node; those with a null doc_id are kept, without a class. Long texts are taken whole,
    an empty table gives an empty result, other columns are ignored.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the sketches are made for a similarity of at least {SIMILARITY}")
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    digest = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    ids = stored(docs.select("doc_id", digest.alias("digest")), "omh-ids")
    named = ids.where("doc_id is not null")
    heads = named.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    heads = stored(heads, "omh-heads")
    twice = stored(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "omh-twice")
    with_head = ids.join(broadcast_if_small(heads, 1_000_000), "digest", "left").withColumn("head", F.coalesce("head", "doc_id"))
    texts = docs.where("doc_id is not null")
    if twice.isEmpty():
        copies = stored(with_head.where("head <> doc_id").select("doc_id"), "omh-copies")
        texts = texts.join(broadcast_if_small(copies, 1_000_000), "doc_id", "left_anti")
    else:
        own = with_head.where("head = doc_id").select("doc_id", "digest").distinct()
        texts = texts.withColumn("digest", digest).dropDuplicates(["doc_id", "digest"]).join(own, ["doc_id", "digest"], "left_semi")
        texts = stored(texts.select("doc_id", "text"), "omh-texts")
    reach = near_classes(texts, similarity)
    if not twice.isEmpty():  # one doc_id with several texts ties them
        again = broadcast_if_small(twice, 1_000_000)
        same = stored(with_head.where("head <> doc_id").join(again, "doc_id", "left_semi").select("head", "doc_id").distinct(), "omh-same")
        reach = reach.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same)
        reach = stored(components(reach), "omh-reach")
    reach = reach.withColumnRenamed("node", "head")
    rows = with_head.join(broadcast_if_small(reach, 1_000_000), "head", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "head"))
    return rows.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))
