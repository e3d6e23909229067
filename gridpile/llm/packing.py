"""Packing by optimal length buckets: dynamic programming over the global histogram of lengths, then token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, number_repeats, stored, text_or_empty

BUCKETS = 12
TOKEN_BUDGET = 16_384
#: Shards that one task numbers.
_GROUP = 1024


def _least(best: np.ndarray, lengths: np.ndarray, texts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j the least of best[i] + cost(i, j) over i < j, and the first i that has it.

    The best i never falls as j grows, so the middle j of a range halves the candidates of those on either side; all ranges of
    a depth are done together, in n log n steps.
    """
    m = len(lengths)
    new, last = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
    new[0] = 0
    low, high, first, end = (np.array([x], np.int64) for x in (1, m, 0, m - 1))  # j in low..high, i in first..end
    while len(low):
        mid = (low + high) // 2
        top = np.minimum(end, mid - 1)
        size = top - first + 1
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        i = np.arange(size.sum()) - np.repeat(begin - first, size)
        j = np.repeat(mid, size)
        cost = best[i] + lengths[j - 1] * (texts[j] - texts[i]) - (tokens[j] - tokens[i])
        least = np.minimum.reduceat(cost, begin)
        hit = np.flatnonzero(cost == np.repeat(least, size))
        which = np.repeat(np.arange(len(mid)), size)[hit]
        pick = i[hit[np.concatenate([[True], which[1:] != which[:-1]])]]
        new[mid], last[mid] = least, pick
        left, right = low < mid, mid < high
        low, high, first, end = (np.concatenate(x) for x in (
            (low[left], mid[right] + 1), (mid[left] - 1, high[right]), (first[left], pick[right]), (pick[left], end[right])))
    return new, last


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most that many buckets for which padding every text to its bucket's bound wastes least.

    lengths ascend. cost(i, j) of one bucket over lengths i..j-1 is lengths[j-1] * (number of texts) - (their tokens); best[j]
    is the least cost for the first j lengths, found for one bucket more in each of the rounds.
    """
    m = len(lengths)
    if not m:
        return []
    texts = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths.astype(np.float64))])
    best = np.full(m + 1, np.inf)
    best[0] = 0
    came = []
    for _ in range(min(buckets, m)):
        best, last = _least(best, lengths.astype(np.float64), texts, tokens)
        came.append(last)
    bounds, j = [], m
    for last in reversed(came):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(last[j])
    return bounds[::-1]


def pack(documents: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, shard_rows: int = 2048, seed: int = 0) -> DataFrame:
    """Deals every document to a batch: doc_id, n_tokens, padded_len (its bucket's bound), bucket, batch, slot, batch_rows.

    Tokens are words. Batches of a bucket hold floor(budget / bound) texts (a text longer than the budget is alone in its
    batch), so a batch padded to its bound keeps the budget; only the last of a bucket is short. Rows of a bucket are spread
    over shards by hash and numbered inside each, and a prefix sum over the shards' counts makes the numbers run on: no task
    sorts a whole bucket. The driver holds one count for each length that occurs, however many texts have it. Null and empty
    texts have length 0 and fill a bucket of bound 0 with `budget` texts a batch. Rows that share id and length are numbered
    and spread by that number too, and each gets a slot of its own; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("bigint").alias("n_tokens"))
    rows = number_repeats(stored(rows, "pack-lengths"), ["doc_id", "n_tokens"])
    histogram = rows.groupBy(F.col("n_tokens").alias("length")).count().orderBy("length").toPandas()
    bounds = optimal_bounds(histogram["length"].to_numpy(), histogram["count"].to_numpy(), buckets)
    per_bucket = np.add.reduceat(histogram["count"].to_numpy(), np.searchsorted(histogram["length"].to_numpy(), [-1, *bounds[:-1]], "right")) if bounds else []
    shards = [max(1, int(n) // shard_rows) for n in per_bucket]
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds or [0]])
    numbers = F.array(*[F.lit(s).cast("bigint") for s in shards or [1]])
    rows = rows.withColumn("bucket", F.size(F.filter(table, lambda b: b < F.col("n_tokens"))).cast("int"))
    rows = rows.withColumn("padded_len", F.element_at(table, F.col("bucket") + 1))
    # shards differ in size only by chance
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "_nth", F.lit(seed)), F.element_at(numbers, F.col("bucket") + 1)))
    counts = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("group", F.floor(F.col("shard") / _GROUP)), "pack-counts")
    groups = counts.groupBy("bucket", "group").agg(F.sum("n").alias("g"))
    groups = groups.withColumn("before", F.sum("g").over(Window.partitionBy("bucket").orderBy("group")) - F.col("g")).withColumn("bucket_rows", F.sum("g").over(Window.partitionBy("bucket")))
    counts = counts.withColumn("inside", F.sum("n").over(Window.partitionBy("bucket", "group").orderBy("shard")) - F.col("n"))
    counts = counts.join(broadcast_if_small(groups.drop("g")), ["bucket", "group"]).select("bucket", "shard", (F.col("before") + F.col("inside")).alias("start"), "bucket_rows")
    counts = broadcast_if_small(stored(counts, "pack-shards"))
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "_nth")
    numbered = rows.withColumn("rank", F.row_number().over(inside)).join(counts, ["bucket", "shard"])
    rank = F.col("start") + F.col("rank") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_len", F.lit(1)))).cast("bigint")
    batch = F.floor(rank / capacity).cast("bigint")
    return numbered.select(
        "doc_id", "n_tokens", "padded_len", "bucket", batch.alias("batch"), (rank % capacity).cast("bigint").alias("slot"),
        F.least(capacity, F.col("bucket_rows") - batch * capacity).cast("bigint").alias("batch_rows"), (F.col("padded_len") - F.col("n_tokens")).alias("padding"),
    )
