"""Helpers shared by the corpus operators: scratch tables, word hashing in numpy, safe column handling."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (spark.checkpoint.dir); a local one only where that is unset and Spark is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gridpile-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most 1000 rows, so that a worker's memory stays small; a smaller setting stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Marks df for broadcasting only after counting that it has at most most_rows rows; else joins shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def number_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with column _nth: 0 for rows whose keys no other row has, else 1 to n over the n rows that share them, in any order.

    Rows are numbered in the partitions they come from, and those numbers run on by the partitions' counts, so a key that very
    many rows share is no group of one task. df is read more than once and should be cheap to read.
    """
    repeated = stored(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeats")
    if repeated.isEmpty():
        return df.withColumn("_nth", F.lit(0).cast("bigint"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    repeated = broadcast_if_small(repeated)
    once = df.join(repeated, same(df, repeated), "left_anti").withColumn("_nth", F.lit(0).cast("bigint"))
    again = df.join(repeated, same(df, repeated), "left_semi").withColumn("_i", F.monotonically_increasing_id())
    again = stored(again.withColumn("_part", F.shiftright("_i", 33)), "repeated-rows")
    parts = again.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    parts = parts.withColumn("_start", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_c")).drop("_c")
    parts = broadcast_if_small(stored(parts, "repeat-parts"))
    again = again.withColumn("_in_part", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_i")))
    again = again.join(parts, same(again, parts) & (again["_part"] == parts["_part"])).select(*[again[c] for c in df.columns], (parts["_start"] + again["_in_part"]).alias("_nth"))
    return once.unionByName(again)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


# ---------------------------------------------------------------- words

#: Words are runs of anything but these bytes (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 21
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, _SLICE + 1)
        base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on every bit of h."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _suffix_cells(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A byte for each word, hashed from its last three bytes."""
    cell = np.zeros(len(end), np.uint32)
    for k, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 1):
        at = end - k
        cell ^= np.where(at >= begin, data[np.maximum(at, 0)].astype(np.uint32) + np.uint32(1), np.uint32(0)) * np.uint32(factor)
    return (cell * np.uint32(0x27D4EB2F) >> np.uint32(24)).astype(np.uint64)


def _hash_block(data: np.ndarray, starts: np.ndarray, suffixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a block of bytes, and the place of each word's first byte. starts: of rows, where words end too."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = mix((total[end] - total[begin]) * inverse[begin])
    return (h & ~np.uint64(0xFF) | _suffix_cells(data, begin, end)) if suffixes else h, begin


def word_hashes(texts: pa.Array, lower: bool = False, suffixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch of texts (null: none), and the offsets of each row's words in them.

    suffixes: the low byte of a hash is a hash of the word's last three bytes.

    Works on slices of the batch's UTF-8 buffer, so memory stays bounded for long rows; a row longer than a slice is cut at a space.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    hashes, places = [], []
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = min(at + _SLICE, stop)
        if end < stop:
            row_end = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if row_end > at:
                end = row_end
            else:  # one row fills the slice
                spaces = np.flatnonzero(_SPACE[raw[at:end]])
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
                else:
                    row_end = int(offsets[np.searchsorted(offsets, at, "right")])
                    more = np.flatnonzero(_SPACE[raw[end:row_end]])
                    end = end + int(more[0]) if len(more) else row_end
        data = raw[at:end]
        h, begin = _hash_block(_LOWER[data] if lower else data, offsets[(offsets > at) & (offsets < end)] - at, suffixes)
        hashes.append(h)
        places.append(begin + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    p = np.concatenate(places) if places else np.zeros(0, np.int64)
    return h, np.searchsorted(p, offsets).astype(np.int64)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(h: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row, in text order, and the rows' offsets. A row of 1 to k-1 words has one shingle of all its words."""
    counts = np.diff(offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    full = np.zeros(0, np.uint64)
    keep = np.zeros(0, bool)
    if len(h) >= k:
        m = len(h) - k + 1
        full = np.zeros(m, np.uint64)
        for j in range(k):
            full *= _STEP
            full += h[j : j + m]
        keep = row[:m] == row[k - 1 :]
        full = mix(full[keep])
    rows = row[: len(keep)][keep] if len(keep) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        v = np.full(len(short), 0x51, np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            v[has] = v[has] * _STEP + h[offsets[short[has]] + j]
        rows = np.concatenate([rows, short])
        full = np.concatenate([full, mix(v)])
        order = np.argsort(rows, kind="stable")
        rows, full = rows[order], full[order]
    return full, np.searchsorted(rows, np.arange(len(counts) + 1)).astype(np.int64)
