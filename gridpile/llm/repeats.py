"""Removes long repeated byte strings by a distributed merge sort of sampled suffixes that never compares a known prefix again.

A string of LENGTH bytes that occurs twice holds the same sampled place in both occurrences: the least hash of GRAM bytes in it.
So suffixes are sorted at those places alone, about one in 90. A task sorts its suffixes into runs, collapses equal ones and
front-codes the rest: each keeps what its predecessor does not have. Runs are cut at splitters and exchanged in that form, and a
loser tree merges them by the common prefixes that are already known (those inside a run come with it). A suffix counts with GRAM
bytes of text, then a fingerprint of all strings that it stands for, those of LENGTH bytes whose sampled place it is. After the
merge equal fingerprints are adjacent, and all strings of such a suffix are repeated; where only the first bytes are equal, as at
the ends of a shared passage, the texts around are fetched and their strings compared one by one, by fingerprints of 128 bits.

Texts are known by the first bytes of their SHA-256, so equal texts are one. No group of equal passages meets in one task: runs
and partial sums collapse equal ones before any exchange, and splitters cut between fingerprints too.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, mix, small_batches, stored

LENGTH = 200
GRAM = 24
_REACH = LENGTH - GRAM + 1
KEY = GRAM + 16
DIGEST = 12
#: Suffixes of a run, and of a part of the exchange.
RUN, PART = 400_000, 100_000
#: Contexts compared in one task, on average, and those that share their first bytes before they are compared row by row.
BUCKET, LARGE = 8_000, 20_000
#: Suffixes that the splitters are taken from, for each part and in all; they only decide how even the parts are.
SAMPLE, MOST_SAMPLED = 100, 1_000_000
_STEP = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


_known_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of two odd bases modulo 2**64, and of their inverses, for a step of text."""
    if not _known_powers:
        for base in _BASES:
            pair = [np.full(_STEP + LENGTH + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
            for p in pair:
                p[0] = 1
            _known_powers.append(tuple(np.cumprod(p, dtype=np.uint64) for p in pair))
    return _known_powers


class _Sums:
    """Prefix sums of a piece of text, which give the fingerprint of any of its strings."""

    def __init__(self, data: np.ndarray):
        self.totals = []
        wide = data.astype(np.uint64) + np.uint64(1)
        for power, inverse in _powers():
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(wide * power[: len(data)], out=total[1:])
            self.totals.append((total, inverse))

    def of(self, begin: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        total, inverse = self.totals[k]
        return (total[end] - total[begin]) * inverse[begin]


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts and the rows' offsets in them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw, offsets


def _sampled(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sampled suffixes of a batch: keys (n x KEY bytes), their row, and the first and last start, in the row, of the strings they stand for."""
    for at in range(int(offsets[0]), int(offsets[-1]), _STEP):
        data = raw[at : min(at + _STEP + LENGTH - 1, int(offsets[-1]))]
        n = len(data) - LENGTH + 1
        if n <= 0:
            continue
        sums = _Sums(data)
        place = np.arange(len(data) - GRAM + 1)
        h = mix(sums.of(place, place + GRAM, 0)) & ~np.uint64(0xFFFFFFFF) | place.astype(np.uint64)
        # least value of every stretch of _REACH: of the rest of one block and the beginning of the next
        blocks = np.full(-(-len(h) // _REACH) * _REACH, ~np.uint64(0))
        blocks[: len(h)] = h
        blocks = blocks.reshape(-1, _REACH)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:n], ahead[_REACH - 1 : _REACH - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(n)
        row = np.searchsorted(offsets, start + at, "right") - 1
        whole = start + at + LENGTH <= offsets[row + 1]
        start, anchor, row = start[whole], anchor[whole], row[whole]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
        low, high = start[new], start[np.append(new[1:], len(start)) - 1]
        anchor, row = anchor[new], row[new]
        shape = (((anchor - low) << 8) + high - low).astype(np.uint64)
        keys = np.empty((len(new), KEY), np.uint8)
        keys[:, :GRAM] = data[anchor[:, None] + np.arange(GRAM)]
        for k in (0, 1):
            keys[:, GRAM + 8 * k : GRAM + 8 * k + 8] = mix(sums.of(low, high + LENGTH, k) + mix(shape + np.uint64(k))).astype(">u8").view(np.uint8).reshape(-1, 8)
        base = at - offsets[row]
        yield keys, row, low + base, high + base


_RUNS = "part int, keys int, lcps binary, rests binary, counts binary, digests binary, places binary"


def _front_coded(keys: np.ndarray, digests: np.ndarray, low: np.ndarray, high: np.ndarray, splitters: list[bytes]) -> Iterator[tuple]:
    """A run in parts: its keys sorted, equal ones collapsed, each without what it has in common with the one before."""
    wide = keys.view(">u8").astype(np.uint64)
    order = np.lexsort(wide.T[::-1])
    keys, digests, low, high = keys[order], digests[order], low[order], high[order]
    differs = np.empty((len(keys), KEY + 1), bool)
    differs[0, :] = True
    differs[1:, :KEY] = keys[1:] != keys[:-1]
    differs[:, KEY] = True
    lcp = differs.argmax(axis=1)
    first = np.flatnonzero(lcp < KEY)
    count = np.diff(np.append(first, len(keys))).astype(np.int32)
    keys, lcp = keys[first], lcp[first]
    cuts = [0, *(bisect.bisect_left(range(len(keys)), s, key=lambda i: keys[i].tobytes()) for s in splitters), len(keys)]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            own = lcp[a:b].astype(np.uint8)
            own[0] = 0
            refs = slice(first[a], first[b] if b < len(first) else len(low))
            rest = keys[a:b][np.arange(KEY) >= own[:, None]]
            places = np.stack([low[refs], high[refs] - low[refs]], axis=1).astype(np.uint32)
            yield part, b - a, own.tobytes(), rest.tobytes(), count[a:b].tobytes(), digests[refs].tobytes(), places.tobytes()


def _runs(texts: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Sorted, front-coded runs of the texts' sampled suffixes, cut at the splitters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        schema = pa.schema([("part", pa.int32()), ("keys", pa.int32()), *((c, pa.binary()) for c in ("lcps", "rests", "counts", "digests", "places"))])

        def write() -> Iterator[pa.RecordBatch]:
            for row in _front_coded(*(np.concatenate(c) for c in zip(*held, strict=True)), splitters):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)
            held.clear()

        n = 0
        for b in batches:
            digests = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, DIGEST)
            raw, offsets = _utf8(b.column(1))
            for keys, row, low, high in _sampled(raw, offsets):
                held.append((keys, digests[row], low, high))
                n += len(keys)
                if n >= RUN:
                    yield from write()
                    n = 0
        if n:
            yield from write()

    return texts.select("digest", "text").mapInArrow(run, _RUNS)


def _splitters(texts: DataFrame, size: int, parts: int) -> list[bytes]:
    """Keys that cut all suffixes into parts of about the same size, from a sample of texts of bounded size."""
    if parts < 2:
        return []
    wanted = min(SAMPLE * parts, MOST_SAMPLED)
    one_in = max(1, int(size / 90 / wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, *_ in _sampled(*_utf8(b.column(0))):
                # of a long text, or of many, every so many-th suffix by its fingerprint
                keys = keys[keys[:, KEY - 8 :].copy().view(">u8").ravel() % 8 == 0]
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], ["key"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, one_in // 8))) == 0)
    keys = sorted(r.key for r in some.select("text").mapInArrow(run, "key binary").distinct().collect())
    return [bytes(keys[len(keys) * k // parts]) for k in range(1, parts)] if keys else []


def merged(runs: list[tuple[bytes, bytes]]) -> tuple[list[int], list[int], list[bytes]]:
    """Merges front-coded runs (lcps, rests): the runs in the order of their keys, what each key has in common with the one before,
    and the different first GRAM bytes in order.

    A loser tree. A node keeps the loser of its match and how long a prefix it shares with the winner; whoever shares more with
    the last key that went out is the smaller, and only at equal lengths are bytes looked at, from that length on.
    """
    width = len(runs)
    keys: list[bytes | None] = [b""] * width
    places, ends, steps = [0] * width, [len(lcps) for lcps, _ in runs], [0] * width

    def advance(r: int) -> int:
        """The next key of run r, and its prefix in common with the one before; -1 at the run's end."""
        at = places[r]
        if at == ends[r]:
            keys[r] = None
            return -1
        same = runs[r][0][at]
        size = KEY - same
        keys[r] = keys[r][:same] + runs[r][1][steps[r] : steps[r] + size]
        steps[r] += size
        places[r] = at + 1
        return same

    def match(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and its common length with the last key out, loser and its common length with the winner."""
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        x, y = keys[a], keys[b]
        if x is None or y is None:
            return (b, lb, a, la) if x is None else (a, la, b, lb)
        h = la
        while h < KEY and x[h] == y[h]:
            h += 1
        return (a, la, b, h) if h == KEY or x[h] < y[h] else (b, lb, a, h)

    size = 1
    while size < width:
        size *= 2
    loser, common = [-1] * size, [-1] * size

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            r = node - size
            return (r, advance(r)) if r < width else (-1, -1)
        (a, la), (b, lb) = build(2 * node), build(2 * node + 1)
        if a < 0 or b < 0:
            a, la, b, lb = (a, la, b, lb) if b < 0 else (b, lb, a, la)
        else:
            a, la, b, lb = match(a, la, b, lb)
        loser[node], common[node] = b, lb
        return a, la

    # at the start nothing has gone out: all keys share nothing with it
    winner, length = build(1)
    out, shared, heads = [], [], []
    while winner >= 0 and keys[winner] is not None:
        out.append(winner)
        shared.append(length)
        if length < GRAM or not heads:
            heads.append(keys[winner][:GRAM])
        r, length = winner, advance(winner)
        node = (r + size) >> 1
        while node:
            other = loser[node]
            if other >= 0:
                lo = common[node]
                if length > lo:
                    pass
                elif length < lo:
                    loser[node], common[node] = r, length
                    r, length = other, lo
                else:
                    r, length, loser[node], common[node] = match(r, length, other, lo)
            node >>= 1
        winner = r
    return out, shared, heads


_FOUND = "digest binary, low int, high int, gram bigint, repeated boolean, compare boolean"


def _merge_part(splitters: list[bytes]):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = table.to_pylist()
        order, shared, heads = merged([(r["lcps"], r["rests"]) for r in rows])
        order, shared = np.array(order, np.int64), np.array(shared, np.int64)
        # a run's keys come in its own order: number them run by run
        base = np.cumsum([0] + [r["keys"] for r in rows])
        entry = np.empty(len(order), np.int64)
        entry[np.argsort(order, kind="stable")] = np.arange(len(order))
        counts = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in rows])
        digests = np.concatenate([np.frombuffer(r["digests"], np.uint8) for r in rows]).reshape(-1, DIGEST)
        places = np.concatenate([np.frombuffer(r["places"], np.uint32) for r in rows]).reshape(-1, 2).astype(np.int64)
        refs = np.concatenate([[0], np.cumsum(counts)])
        assert base[-1] == len(order)
        key = np.cumsum(np.concatenate([[1], shared[1:] < KEY])) - 1
        group = np.cumsum(np.concatenate([[1], shared[1:] < GRAM])) - 1
        times = np.bincount(key, weights=counts[entry])
        first_of_key = np.flatnonzero(np.concatenate([[True], shared[1:] < KEY]))
        kinds = np.bincount(group[first_of_key], minlength=group[-1] + 1)
        # a group that a splitter may have cut has members in another part
        ends = [keyed[:GRAM] for keyed in ([splitters[part - 1]] if part else []) + ([splitters[part]] if part < len(splitters) else [])]
        kinds[0] += heads[0] in ends
        kinds[-1] += heads[-1] in ends
        repeated = times[key] >= 2
        compare = kinds[group] >= 2
        head = np.zeros(len(key), bool)
        head[first_of_key] = True
        keep = repeated | compare
        entry, repeated, compare, head, group = entry[keep], repeated[keep], compare[keep], head[keep], group[keep]
        number = {g: int.from_bytes(hashlib.blake2b(heads[g], digest_size=8).digest(), "big", signed=True) for g in np.unique(group)}
        n = counts[entry]
        at = np.repeat(refs[entry] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        repeated, compare = np.repeat(repeated, n), np.repeat(compare, n)
        gram = np.repeat(np.array([number[g] for g in group], np.int64), n)
        # of a repeated suffix one occurrence stands for all in comparisons
        lead = np.zeros(len(at), bool)
        lead[(np.cumsum(n) - n)[head]] = True
        compare &= ~repeated | lead
        return pa.table({
            "digest": pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(at), [None, pa.py_buffer(np.ascontiguousarray(digests[at]))]).cast(pa.binary()),
            "low": pa.array(places[at, 0].astype(np.int32)), "high": pa.array(places[at].sum(axis=1).astype(np.int32)), "gram": pa.array(gram), "repeated": pa.array(repeated), "compare": pa.array(compare)})

    return run


def _packed(texts: DataFrame) -> DataFrame:
    """Texts (digest, text) as (digest, size, packed), compressed for the way to other tasks; of equal texts a task gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = pa.Codec("zstd", 3), set()
        for b in batches:
            out = []
            for digest, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    raw = text.as_buffer()
                    out.append((digest, raw.size, codec.compress(raw, asbytes=True)))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary()), strict=True)], ["digest", "size", "packed"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, size int, packed binary")


_CONTEXT = "gram bigint, digest binary, low int, repeated boolean, around binary"


def _contexts(rows: DataFrame) -> DataFrame:
    """The text around suffixes: for rows (digest, size, packed, spans) what the strings of each span cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for b in batches:
            for digest, size, packed, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = codec.decompress(packed, size, asbytes=True)
                cut = [text[s["low"] : s["high"] + LENGTH] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["gram"] for s in spans], pa.int64()), pa.array([digest] * len(cut), pa.binary()), pa.array([s["low"] for s in spans], pa.int32()), pa.array([s["repeated"] for s in spans]), pa.array(cut, pa.binary())],
                    ["gram", "digest", "low", "repeated", "around"])

    return rows.select("digest", "size", "packed", "spans").mapInArrow(run, _CONTEXT)


def _strings(around: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All strings of LENGTH bytes of some contexts, in pieces: the context, its place in there, and two hashes."""
    at = 0
    while at < len(around):
        end, size = at, 0
        while end < len(around) and size + len(around[end]) <= _STEP:
            size += len(around[end])
            end += 1
        sums = _Sums(np.frombuffer(b"".join(around[at:end]), np.uint8))
        lengths = np.array([len(x) for x in around[at:end]])
        n = lengths - LENGTH + 1
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = place + np.repeat(np.cumsum(lengths) - lengths, n)
        yield np.repeat(np.arange(at, end), n), place, *(mix(sums.of(begin, begin + LENGTH, k)).view(np.int64) for k in (0, 1))
        at = end


def _compare_bucket(table: pa.Table) -> pa.Table:
    """(digest, low, high) of the strings of contexts that are repeated among them; equal strings are in one bucket."""
    row, place, a, b = (np.concatenate(x) for x in zip(*_strings(table.column("around").to_pylist()), strict=True))
    done = table.column("repeated").to_numpy(zero_copy_only=False)
    weight = np.where(done, 2, 1)[row]
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    twice = np.empty(len(row), bool)
    twice[order] = (np.add.reduceat(weight[order], np.flatnonzero(new)) >= 2)[np.cumsum(new) - 1]
    hit = np.flatnonzero(twice & ~done[row])
    first = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)]) if len(hit) else np.zeros(0, bool)
    begin, end = hit[first], hit[np.append(first[1:], True)] if len(hit) else hit
    low = table.column("low").to_numpy()[row[begin]]
    return pa.table({"digest": table.column("digest").take(pa.array(row[begin])), "low": pa.array((low + place[begin]).astype(np.int32)), "high": pa.array((low + place[end]).astype(np.int32))})


def _compared(contexts: DataFrame) -> DataFrame:
    """Every string of the contexts as a row: its hashes a and b, weight, digest and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            low, done = x.column(2).to_numpy(), x.column(3).to_numpy(zero_copy_only=False)
            for row, place, a, b in _strings(x.column(4).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(np.where(done[row], 2, 1).astype(np.int32)), x.column(1).take(pa.array(row)), pa.array((low[row] + place).astype(np.int32))],
                    ["a", "b", "weight", "digest", "place"])

    return contexts.mapInArrow(run, "a bigint, b bigint, weight int, digest binary, place int")


def _cut(rows: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256) of rows (digest, size, packed, spans of low, high): the text without what the repeated strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for b in batches:
            out = []
            for digest, size, packed, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = np.frombuffer(codec.decompress(packed, size, asbytes=True), np.uint8)
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, [s["low"] for s in spans], 1)
                np.add.at(edge, [s["high"] + LENGTH for s in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = text[~gone].tobytes()
                out.append((digest, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["digest", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("digest", "size", "packed", "spans").mapInArrow(run, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(digest, spans) of every different text of texts (digest, text) that holds strings of LENGTH bytes that also start elsewhere:
    the first and last start of each stretch of them. texts is read several times."""
    small_batches(texts.sparkSession)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splitters = _splitters(texts, size, -(-size // (90 * PART)))
    found = stored(_runs(texts, splitters).groupBy("part").applyInArrow(_merge_part(splitters), _FOUND), "repeated-suffixes")
    asked = found.where("compare").groupBy("digest").agg(F.collect_list(F.struct("low", "high", "gram", "repeated")).alias("spans"))
    contexts = stored(_contexts(_packed(texts).join(asked, "digest")), "contexts")
    grams = contexts.groupBy("gram").agg(F.count("*").alias("n"))
    sizes = stored(grams.groupBy((F.col("n") > LARGE).alias("large")).agg(F.sum("n").alias("n")), "context-sizes")
    n = {r.large: r.n for r in sizes.collect()}
    more, usual = None, contexts
    if True in n:
        # first bytes that very many different texts share: their strings meet row by row, in partial sums
        large = broadcast_if_small(stored(grams.where(F.col("n") > LARGE).select("gram"), "large-grams"))
        strings = stored(_compared(contexts.join(large, "gram", "left_semi")), "compared-strings")
        twice = strings.groupBy("a", "b").agg(F.sum("weight").alias("times")).where("times > 1").select("a", "b")
        more = strings.where("weight = 1").join(twice, ["a", "b"]).select("digest", F.col("place").alias("low"), F.col("place").alias("high"))
        usual = contexts.join(large, "gram", "left_anti")
    buckets = -(-n.get(False, 0) // BUCKET) or 1
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket")
    within = usual.select(bucket, "digest", "low", "repeated", "around").groupBy("bucket").applyInArrow(_compare_bucket, "digest binary, low int, high int")
    more = within if more is None else more.unionByName(within)
    every = found.where("repeated").select("digest", "low", "high").unionByName(more)
    return every.groupBy("digest").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Every document without the bytes that repeated strings cover: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LENGTH bytes of its text covers it that also starts anywhere else, in the same text or another;
    strings are judged on the texts as they come, and never reach from one into the next. So of two equal texts of LENGTH bytes or more
    nothing is left, and rows that repeat, null ids too, have a row each with equal results. Null and empty texts, and those of
    fewer than LENGTH bytes, keep what they have. Texts of any length are read whole; an empty table gives none; other columns are
    ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("digest", F.substring(F.unhex("sha"), 1, DIGEST))
    texts = rows.where(F.octet_length("text") >= LENGTH).select("digest", "text")
    spans = stored(repeated_spans(texts), "repeated-spans")
    cut = _cut(_packed(texts).join(spans, "digest")).dropDuplicates(["digest"])
    out = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest", "sha").join(stored(cut, "cut"), "digest", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
