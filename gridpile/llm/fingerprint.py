"""Threshold-scaled sketches: a text's fingerprint holds every shingle hash below a fixed fraction of the hash space.

Sketches of that kind need no common size: the union of two sketches is the sketch of the united shingles, and the share of
one sketch found in another estimates containment even between a sentence and a book.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shingle_hashes, text_or_empty, word_hashes

SHINGLE = 5
#: The fraction: every shingle hash in the lowest quarter of the hash space is kept, of short texts as of books.
SCALE = 4
_BITS = 48


def sketch_batch(texts: pa.Array, scale: int = SCALE, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct retained hashes of all rows, the rows' offsets, and a digest of each row's words in their order."""
    words, at = word_hashes(texts, lower=True)
    n = len(at) - 1
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place.astype(np.uint64))), dtype=np.uint64)])
    digest = mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))
    h, offsets = shingle_hashes(words, at, k)
    h >>= np.uint64(64 - _BITS)
    keep = h < np.uint64((1 << _BITS) // scale)
    row, h = np.repeat(np.arange(n), np.diff(offsets))[keep], h[keep]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(n + 1)).astype(np.int64), digest


def to_string(h: np.ndarray, digest: int | None) -> str:
    """'<scale>:<digest of the words>:' and the retained hashes in ascending order, 12 hexadecimal digits each; a united sketch has no digest."""
    big = h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return f"{SCALE}:{'' if digest is None else format(int(digest), '016x')}:{big.tobytes().hex()}"


def from_string(s: str) -> tuple[np.ndarray, int | None]:
    scale, digest, digits = s.split(":")
    if int(scale) != SCALE:
        raise ValueError(f"a sketch of another fraction: 1/{scale}")
    raw = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, 6)
    big = np.zeros((len(raw), 8), np.uint8)
    big[:, 2:] = raw
    return big.view(">u8").ravel().astype(np.uint64), int(digest, 16) if digest else None


def likeness(a: np.ndarray, a_digest: int | None, b: np.ndarray, b_digest: int | None) -> tuple[float, float, float]:
    """Estimates from two sketches: share of the smaller set found in the larger, containment of a in b, Jaccard.

    Texts of equal words are alike (1), also where nothing was retained; of other texts a side that retained nothing, as a short
    text may, shows nothing in common (0).
    """
    if a_digest is not None and a_digest == b_digest:
        return 1.0, 1.0, 1.0
    if not len(a) or not len(b):
        return 0.0, 0.0, 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    common = int((large[place] == small).sum())
    return common / len(small), common / len(a), common / (len(a) + len(b) - common)


def merge(a: str, b: str) -> str:
    """The sketch of two texts' united shingles."""
    return to_string(np.union1d(from_string(a)[0], from_string(b)[0]), None)


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds column fingerprint to any table with a text column; nothing is shuffled. Null texts count as empty."""
    schema = df.drop("fingerprint").withColumn("fingerprint", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, offsets, digest = sketch_batch(b.column(b.schema.get_field_index(text)))
            made = [to_string(h[offsets[i] : offsets[i + 1]], digest[i]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, "fingerprint"])

    return df.drop("fingerprint").mapInArrow(run, schema)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIRST = -(1 << 63)
#: Ids that more ranges than these would hold are split by their texts; smaller ones lie in one range.
_WHOLE_ID = 8
_SUBS = 1 << 16


def _prefix(text: str = "text") -> F.Column:
    """The text's first 7 bytes as a number, in the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.substring(text, 1, 7), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def _split_ids(df: DataFrame, bounds: list[int]) -> list[tuple[int, list[int]]]:
    """(id, bounds of _prefix) of ids that are many of the ranges' bounds, which have at most twice as many here."""
    many = Counter(bounds)
    octaves: dict[int, list[int]] = {}
    for i, n in many.items():
        if n > _WHOLE_ID:
            octaves.setdefault(n.bit_length(), []).append(i)
    found = []
    for k, ids in octaves.items():
        listed = F.broadcast(df.sparkSession.createDataFrame([(i,) for i in ids], "_key bigint"))
        cuts = F.percentile_approx(_prefix(), [j / (1 << k) for j in range(1, 1 << k)], 10 << k)
        found += [(r._key, sorted(set(r.b))) for r in df.join(listed, "_key").groupBy("_key").agg(cuts.alias("b")).collect()]
    return found


def _range_of(df: DataFrame, rows_each: int) -> tuple[DataFrame, bool]:
    """Adds _key, the id with null as the least number, _prefix, and _range, the number of the range that a row falls in.

    Ranges follow the order of (id, text) and hold about rows_each rows, by quantiles of the ids. An id that very many rows share
    has ranges of its own by the first bytes of its texts; rows whose texts begin alike stay together. The second result tells
    whether there is such an id; if not, _prefix is 0.
    """
    df = df.withColumn("_key", F.coalesce("doc_id", F.lit(_FIRST)))
    whole = df.withColumn("_prefix", F.lit(0).cast("bigint"))
    n = df.count()
    ranges = int(min(32_768, max(1, -(-n // rows_each))))
    if ranges == 1:
        return whole.withColumn("_range", F.lit(0).cast("bigint")), False
    every = df.select(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("b")).first().b or []
    bounds = sorted(set(every))
    if not bounds:
        return whole.withColumn("_range", F.lit(0).cast("bigint")), False
    groups = [bounds[i : i + 32] for i in range(0, len(bounds), 32)]
    coarse = F.array(*[F.lit(g[0]) for g in groups[1:]]) if len(groups) > 1 else F.array().cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    above = lambda values: F.size(F.filter(values, lambda x: x <= F.col("_key")))
    number = lambda df: df.withColumn("_coarse", above(coarse)).withColumn("_range", F.col("_coarse").cast("bigint") * 32 + above(F.element_at(fine, F.col("_coarse") + 1))).drop("_coarse")
    split = _split_ids(df, every)
    if not split:
        return number(whole), False
    # one row for each split id; their bounds are at most twice as many as the ranges
    table = df.sparkSession.createDataFrame(split, "_key bigint, _cuts array<bigint>")
    rows = number(df).withColumn("_prefix", _prefix()).join(F.broadcast(table), "_key", "left")
    # a split id is a bound, so it begins its range; larger ids of that range come after it
    start = number(table.select("_key")).select("_range", F.lit(True).alias("_begun"))
    rows = rows.join(F.broadcast(start), "_range", "left")
    sub = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda x: x <= F.col("_prefix")))).when(F.col("_begun"), _SUBS - 1).otherwise(0)
    return rows.withColumn("_range", F.col("_range") * _SUBS + sub).drop("_cuts", "_begun"), True


def fingerprint_edits(documents: DataFrame, rows_each: int = 500) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has its last floor(n/2) code points replaced by the first of the next document's (by doc_id; the last's
    next is the first). Documents are dealt once into ranges of ids, read in order, and each range also gets the first row of
    the next, so no other exchange and no global order is needed. Null ids come first. Equal ids, null ones too, are ordered by
    text; where very many rows share an id they are split into ranges by the first bytes of their texts, and only rows whose
    texts begin alike stay together (a range is streamed, not held). Null texts are empty; a lone document follows itself; an
    empty table gives an empty result. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    docs, _ = _range_of(docs, rows_each)
    firsts = sorted((r._range, *r.f) for r in docs.groupBy("_range").agg(F.min(F.struct("_key", "_prefix")).alias("f")).collect())
    if not firsts:
        firsts = [(0, 0, 0)]
    # one row for each range: (range that needs it, id and text's first bytes of the row); at most 100,000 of them
    ghosts = [(r, *firsts[(i + 1) % len(firsts)][1:]) for i, (r, *_) in enumerate(firsts)]
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame(ghosts, "_to bigint, _id bigint, _begins bigint"))
    lent = (
        docs.join(wanted, (F.col("_key") == F.col("_id")) & (F.col("_prefix") == F.col("_begins")))
        .groupBy("_to").agg(F.min(F.struct("doc_id", "text")).alias("d"))
        .select(F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text"), F.col("_to").alias("_range"), F.lit(1).alias("_ghost"))
    )
    rows = docs.select("doc_id", "text", "_range", F.lit(0).alias("_ghost")).unionByName(lent)
    rows = rows.repartition("_range").sortWithinPartitions("_range", "_ghost", "doc_id", "text")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, contained_in_next double, next_doc_id bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                held.append(row)
                size += len(row[1])
                if size > 2 << 20:
                    yield from emit(held)
                    held, size = [row], len(row[1])
        yield from emit(held)

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows for all of held but the last, whose next is not known yet; the texts are sketched once each."""
        if len(held) < 2:
            return
        texts = [x[1] for x in held]
        own = [i for i in range(len(held) - 1) if not held[i][3]]
        if not own:
            return
        edits = [_edited(texts[i], texts[i + 1]) for i in own]
        h, o, e = sketch_batch(pa.array(texts, pa.large_string()))
        eh, eo, ee = sketch_batch(pa.array(edits, pa.large_string()))
        out: list[list] = [[] for _ in range(10)]
        for j, i in enumerate(own):
            a, b, c = h[o[i] : o[i + 1]], eh[eo[j] : eo[j + 1]], h[o[i + 1] : o[i + 2]]
            near, _, jaccard = likeness(a, e[i], b, ee[j])
            near_next, inside, _ = likeness(a, e[i], c, e[i + 1])
            row = (held[i][0], len(texts[i]), hashlib.sha256(edits[j].encode()).hexdigest(), to_string(a, e[i]), to_string(b, ee[j]), near, near_next, jaccard, inside, held[i + 1][0])
            for values, v in zip(out, row, strict=True):
                values.append(v)
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4, pa.int64()]
        names = [x.split()[0] for x in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)
