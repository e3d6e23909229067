"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every row has a hash of its id; a source's share of a budget is the rows below a threshold. Words are summed by source and
hash bucket, prefix sums over at most BUCKETS rows a source find the bucket where the budget runs out, and only that bucket is
summed again at a finer grain. The hash is of the row's id, text and source, so rows that share an id are spread too. What is left at
the end, the rows of one fine bucket or rows equal throughout, is taken by k of the n rows of one hash, and what is missing
then is made up by rows of fitting size. Thresholds are nested: a smaller budget takes a subset of a larger one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, number_repeats, stored, text_or_empty

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
_BITS = 12
BUCKETS = 1 << _BITS
#: Rounds of smaller rows for the words that are missing after the threshold.
FILLS = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of all sources, from (source, source_size). Sources by code point, null last, take the weights in turn; their
    targets sum to all sizes, stop at most times their own size, and what that frees goes to the others by weight.

    In closed form: with sources ordered by most * size / weight, the capped ones are those below the level L at which the
    rest, sharing by weight, use up what the capped ones leave. The table has a row for each source, not for each document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("free", F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    table = table.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    table = table.withColumn("level", F.when(F.col("free") / F.col("open") <= F.col("cap") / F.col("weight"), F.col("free") / F.col("open")))
    table = table.withColumn("first_open", F.row_number().over(Window.orderBy(F.col("level").isNull(), F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    table = table.withColumn("level", F.max(F.when(F.col("first_open") == 1, F.col("level"))).over(whole))
    return table.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _cut(sums: DataFrame, bucket: str) -> DataFrame:
    """For sums of words by _key and bucket, with the words wanted: the bucket that the budget ends in and what is left for it."""
    upto = Window.partitionBy("_key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("run", F.sum("words").over(upto))
    cut = run.where((F.col("run") > F.col("wanted")) & (F.col("run") - F.col("words") <= F.col("wanted")))
    return cut.select("_key", bucket, (F.col("wanted") - (F.col("run") - F.col("words"))).alias("left"))


def _threshold(rows: DataFrame) -> DataFrame:
    """(_key, below, left) from rows (_key, _h, size, wanted): rows with _h < below have at most the words wanted, left are missing."""
    cells = rows.withColumn("bucket", F.shiftright("_h", _BITS)).withColumn("sub", F.col("_h").bitwiseAND(BUCKETS - 1))
    by_bucket = stored(cells.groupBy("_key", "wanted", "bucket").agg(F.sum("size").alias("words")), "mix-histogram")
    coarse = stored(_cut(by_bucket, "bucket"), "mix-cut")
    finer = cells.drop("wanted").join(broadcast_if_small(coarse.withColumnRenamed("left", "wanted")), ["_key", "bucket"])
    finer = _cut(finer.groupBy("_key", "wanted", "sub").agg(F.sum("size").alias("words")), "sub").withColumnRenamed("left", "fine")
    every = by_bucket.groupBy("_key", "wanted").agg(F.sum("words").alias("words"))
    found = every.join(coarse, "_key", "left").join(finer, "_key", "left")
    below = F.when(F.col("bucket").isNull(), BUCKETS * BUCKETS).otherwise(F.col("bucket") * BUCKETS + F.coalesce("sub", F.lit(0)))
    return stored(found.select("_key", below.alias("below"), F.coalesce("fine", "left", F.col("wanted") - F.col("words")).alias("left")), "mix-limits")


def _keyed(df: DataFrame) -> DataFrame:
    """Adds a key of the row's source that joins null sources too, and _u, a hash of id, text and source and, where rows repeat all, of their number; _h are its first 2 * _BITS bits."""
    df = df.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    df = number_repeats(df, ["_d"])
    u = F.when(F.col("_nth") == 0, F.col("_d")).otherwise(F.xxhash64("_d", "_nth"))
    return df.withColumn("_u", u).withColumn("_h", F.shiftrightunsigned("_u", 64 - 2 * _BITS).cast("int")).drop("_d", "_nth")


def _digest() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), text_or_empty("text"), F.col("source").cast("string"))


def _words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def plan_mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, source, size, _h, _u, _key) and, for each source, what the mix takes: copies of every row, and one more of
    those with _h < below, of those of at most a size below further thresholds (fills), and of the row extra."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), _words().alias("size"), _digest().alias("_d"))
    rows = _keyed(stored(rows, "mix-sizes"))
    sizes = rows.groupBy("source", "_key").agg(F.sum("size").alias("source_size"))
    sizes = stored(sizes, "mix-sources")
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    targets = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    targets = targets.withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))
    targets = targets.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    targets = stored(targets, "mix-targets")
    limits = _threshold(rows.select("_key", "_h", "size").join(broadcast_if_small(targets.select("_key", "wanted")), "_key"))
    limits = limits.select("_key", "below", "left", F.array().cast("array<struct<most:double,below:int>>").alias("fills"))
    # the words missing are fewer than the next row has: smaller rows fill them up, and then still smaller ones
    for _ in range(FILLS):
        open_rows = rows.select("_key", "_h", "size").join(broadcast_if_small(limits), "_key").where((F.col("size") > 0) & (F.col("size") <= F.col("left")) & ~_once_more(F.col("size")))
        more = _threshold(open_rows.select("_key", "_h", "size", F.col("left").alias("wanted"))).select("_key", F.col("below").alias("b"), F.col("left").alias("l"))
        fill = F.array(F.struct(F.col("left").cast("double").alias("most"), F.col("b").cast("int").alias("below")))
        limits = limits.join(broadcast_if_small(more), "_key", "left")
        limits = stored(limits.select("_key", "below", F.coalesce("l", "left").alias("left"), F.when(F.col("b").isNull(), F.col("fills")).otherwise(F.concat("fills", fill)).alias("fills")), "mix-limits")
    # of all rows not taken, the one whose size comes nearest to what is left goes in
    open_rows = rows.join(broadcast_if_small(limits), "_key").where(~_once_more(F.col("size")))
    nearest = open_rows.groupBy("_key", "left").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), F.col("_u").alias("extra"))).alias("n"))
    nearest = nearest.where(F.col("n.off") < F.col("left")).select("_key", F.col("n.extra").alias("extra"))
    plan = targets.join(limits.drop("left"), "_key", "left").join(nearest, "_key", "left")
    plan = plan.select("_key", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below"), "fills", "extra")
    return rows, broadcast_if_small(stored(plan, "mix-plan"))


def _once_more(size: Column) -> Column:
    fits = F.exists("fills", lambda f: (F.col("_h") < f["below"]) & (size <= f["most"]))
    return (F.col("_h") < F.col("below")) | F.coalesce(fits, F.lit(False))


def _copies(size: Column) -> Column:
    extra = F.coalesce(F.col("_u") == F.col("extra"), F.lit(False))
    return (F.col("copies") + F.when(_once_more(size) | extra, 1).otherwise(0)).cast("bigint")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """How many times the mix takes each document: doc_id, size (words), source_size, target, taken, source, copies.

    A source of size S and target T takes every row floor(T / S) times and those under the hash threshold once more, so no
    row is taken more than most times. Rows with equal ids but other texts or sources are taken each by its own hash; of n rows
    equal in all three k are taken, whichever. A null id hashes as any other value, a null source is a source, a null text has no words,
    and a source without words takes nothing. An empty table gives an empty result. Other columns are ignored.
    """
    rows, plan = plan_mix(documents, weights, most)
    copies = _copies(F.col("size"))
    return rows.join(plan, "_key").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"), "source", copies.alias("copies"))


def apply_mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed corpus: each row of documents as often as the mix takes it. Texts are not shuffled unless sources are too many to broadcast."""
    _, plan = plan_mix(documents, weights, most)
    rows = _keyed(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "source", _digest().alias("_d")))
    taken = rows.join(plan.drop("source_size", "target"), "_key").withColumn("n", _copies(_words("row.text")).cast("int")).where("n > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
