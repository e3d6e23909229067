"""Waffles that grow: batches of contacts arrive as a stream and are added up when read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tiles
from ..operators.waffle import merge_cells, waffle


def stream_waffle(contacts: DataFrame, pairs: DataFrame, span: int, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Adds a stream of contacts (bin1, bin2, raw, nrm, each pair of bins once in all) to the partial waffles in path.

    Each micro-batch writes its sums to a folder of its own number, so a batch that is run again after a failure replaces
    itself. Pairs, and so the counters, are those of the run, not of a batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        waffle(pairs, batch, span).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return contacts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_increments(spark, path: str) -> DataFrame:
    return merge_cells(spark.read.parquet(path).drop("batch").select("grp", F.col("x"), "y", "sum_raw", "sqr_raw", "sum_nrm", "sqr_nrm", "passage"))


def contact_changes(reads: DataFrame, delay: str | None = None, time: str = "time") -> DataFrame:
    """(bin1, bin2, before, after) of a stream of reads (a, b): for each contact that a batch adds to, its count before and after.

    The counts are Spark's keyed state. With a delay, reads whose time lies further back than the latest one less the delay are
    dropped; without, all count.
    """
    ends = reads.select(F.least("a", "b").alias("bin1"), F.greatest("a", "b").alias("bin2"), *[time] * (delay is not None)).where("bin1 is not null and bin2 is not null")
    if delay is not None:
        ends = ends.withWatermark(time, delay)

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        after = before + sum(len(f) for f in frames)
        state.update((after,))
        yield pd.DataFrame({"bin1": [key[0]], "bin2": [key[1]], "before": [before], "after": [after]})

    timeout = GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout
    return ends.groupBy("bin1", "bin2").applyInPandasWithState(count, "bin1 bigint, bin2 bigint, before bigint, after bigint", "n bigint", "update", timeout)


def stream_reads(
    reads: DataFrame, pairs: DataFrame, factors: Callable[[DataFrame], DataFrame], span: int, path: str, checkpoint: str,
    delay: str | None = None, time: str = "time", trigger: dict | None = None,
) -> StreamingQuery:
    """Adds a stream of reads (a, b, and time if there is a delay) to the partial waffles in path, whatever bins come again.

    factors: gives contacts (bin1, bin2, raw) the column nrm, linear in raw, and leaves out what does not count, such as bad bins;
    contacts.normalise after drop_bad does. A batch hands on how each contact's value, its square and its being there change, so
    sums over all batches are those of one run over all reads. A batch that is run again after a failure replaces itself.
    """
    side = tiles.tile_side(span)
    lists = tiles.listed(pairs, span, side)

    def add(batch: DataFrame, number: int) -> None:
        one = factors(batch.withColumn("raw", F.lit(1).cast("bigint")))
        grown, squares = F.col("after") - F.col("before"), F.col("after") * F.col("after") - F.col("before") * F.col("before")
        changes = one.select(
            "bin1", "bin2", grown.alias("sum_raw"), squares.alias("sqr_raw"), (grown * F.col("nrm")).alias("sum_nrm"), (squares * F.col("nrm") * F.col("nrm")).alias("sqr_nrm"),
            F.when(F.col("before") == 0, 1).otherwise(0).alias("passage"))
        tiles.summed(lists, tiles.tiled(changes, side), side, span).write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes = contact_changes(reads, delay, time)
    return changes.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
