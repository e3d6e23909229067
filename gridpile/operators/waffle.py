"""Waffles: the squares of the contact matrix around pairs of peaks, summed cell by cell for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles as T
from .genome import locate
from .pairs import count_pairs, pair_cells


def match_cells(pairs: DataFrame, contacts: DataFrame, span: int) -> DataFrame:
    """(what, what_new, bin1, bin2, x, y, raw, nrm): every contact in the square of every pair; contacts must hold no bad bins.

    Matrix and pairs meet by tiles of the matrix (tiles.py): shuffled are the pairs, up to four times, and the contacts once,
    not side^2 cells of each pair, and only matches become rows.
    """
    side = T.tile_side(span)
    return T.matched(T.listed(pairs, span, side, labels=True), T.tiled(contacts, side), side, span)


def match_cells_by_key(pairs: DataFrame, contacts: DataFrame, windows: DataFrame) -> DataFrame:
    """The same from the pairs' cells, joined on both bins: the plain form that tests compare with."""
    cells = pair_cells(pairs, windows)
    return cells.join(contacts, (F.col("p1") == F.col("bin1")) & (F.col("p2") == F.col("bin2"))).drop("p1", "p2")


def waffle_cells(cells: DataFrame, both_are_feature: bool = False, with_raw: bool = False) -> DataFrame:
    """(grp, x, y, sum_raw, sqr_raw, sum_nrm, sqr_nrm, passage). Sums of raw counts are 0 unless with_raw."""
    grp = F.lit("") if both_are_feature else F.col("what")
    out = cells.groupBy(grp.alias("grp"), "x", "y").agg(
        F.sum(F.col("raw") if with_raw else F.lit(0)).cast("double").alias("sum_raw"),
        F.sum((F.col("raw") * F.col("raw")) if with_raw else F.lit(0)).cast("double").alias("sqr_raw"),
        F.sum("nrm").alias("sum_nrm"), F.sum(F.col("nrm") * F.col("nrm")).alias("sqr_nrm"), F.count("*").alias("passage"))
    return out.select("grp", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "sum_raw", "sqr_raw", "sum_nrm", "sqr_nrm", "passage")


def waffle_head(domain: DataFrame, pairs: DataFrame, resolution: int, span: int, both_are_feature: bool = False) -> DataFrame:
    """(grp, resolution, size, counter) of every group: the domain's, with 0 pairs where there are none, and all labels that pairs have."""
    counts = count_pairs(pairs, both_are_feature)
    out = domain.join(counts, "grp", "full_outer")
    return out.select("grp", F.lit(resolution).cast("int").alias("resolution"), F.lit(2 * span + 1).cast("int").alias("size"), F.coalesce("counter", F.lit(0)).cast("bigint").alias("counter"))


def waffle(pairs: DataFrame, contacts: DataFrame, span: int, both_are_feature: bool = False, with_raw: bool = False) -> DataFrame:
    """waffle_cells of match_cells, added up inside the tiles without a row for each match."""
    side = T.tile_side(span)
    return T.summed(T.listed(pairs, span, side), T.tiled(contacts, side), side, span, both_are_feature, with_raw)


def dense(cells: DataFrame, head: DataFrame) -> DataFrame:
    """All size^2 cells of every group; absent ones are 0. Group heads are few, so the cells of a group are made from them."""
    grid = head.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    return grid.join(cells, ["grp", "x", "y"], "left").select(
        "grp", "x", "y", zero("sum_raw", "double"), zero("sqr_raw", "double"), zero("sum_nrm", "double"), zero("sqr_nrm", "double"), zero("passage", "bigint"), "counter", "size", "resolution")


def mean_over_pairs(dense_cells: DataFrame) -> DataFrame:
    """Mean over all pairs of the group: cells without a contact count as 0; null for a group without pairs."""
    return dense_cells.withColumn("mean", F.try_divide("sum_nrm", "counter"))


def mean_over_observed(cells: DataFrame) -> DataFrame:
    """Mean over the contacts that were there."""
    return cells.withColumn("mean", F.try_divide("sum_nrm", "passage"))


def merge_cells(*parts: DataFrame) -> DataFrame:
    """Waffles of disjoint runs added cell by cell; a group that only some have is taken over."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sums = [F.sum(c).alias(c) for c in ("sum_raw", "sqr_raw", "sum_nrm", "sqr_nrm", "passage")]
    return out.groupBy("grp", "x", "y").agg(*sums)


def merge_heads(*parts: DataFrame) -> DataFrame:
    """Heads of disjoint runs: counters add up. A group whose size or resolution differs between them fails the job that reads it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    made = out.groupBy("grp").agg(F.min("resolution").alias("resolution"), F.min("size").alias("size"), F.sum("counter").alias("counter"), F.max("resolution").alias("_r"), F.max("size").alias("_s"))
    wrong = (F.col("_r") != F.col("resolution")) | (F.col("_s") != F.col("size"))
    fail = F.raise_error(F.lit("waffles of different size or resolution can't be merged")).cast("bigint")
    return made.withColumn("counter", F.when(wrong, fail).otherwise(F.col("counter"))).drop("_r", "_s")


def total(cells: DataFrame) -> DataFrame:
    return cells.agg(F.coalesce(F.sum("sum_nrm"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("passage"), F.lit(0)).cast("bigint").alias("passage"))


def submatrix_rows(cells: DataFrame, genome: DataFrame) -> DataFrame:
    """(chrom1, local1, chrom2, local2, x, y, nrm, grp, what_new) of every matched cell."""
    out = locate(locate(cells, genome, "bin1", "chrom1", "local1"), genome, "bin2", "chrom2", "local2")
    return out.select("chrom1", "local1", "chrom2", "local2", "x", "y", "nrm", F.col("what").alias("grp"), "what_new")


def keyed_rows(cells: DataFrame, span: int) -> DataFrame:
    """(what_new, cell, nrm) of every matched cell, with the cell's number x + y * side."""
    return cells.select("what_new", (F.col("x") + F.col("y") * (2 * span + 1)).cast("int").alias("cell"), "nrm")


def compact(cells: DataFrame, factor: int = 1000) -> DataFrame:
    """Sums as whole thousandths: (grp, x, y, passage, sum_fixed, sqr_fixed)."""
    fixed = lambda c: F.bround(F.col(c) * factor).cast("bigint")
    return cells.select("grp", "x", "y", "passage", fixed("sum_nrm").alias("sum_fixed"), fixed("sqr_nrm").alias("sqr_fixed"))
