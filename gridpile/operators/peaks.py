"""Peaks: binning, the filters that make them usable, and the windows around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bin_peaks(peaks: DataFrame, genome: DataFrame, resolution: int, span: int) -> DataFrame:
    """(chrom, p1, p2, feature) -> distinct (chrom, bin, gbin, feature) of usable peaks.

    The bin is that of the midpoint; p1 may exceed p2. Peaks on unknown chromosomes go, and those whose window of span bins
    to either side does not fit the chromosome.
    """
    s = genome.select("chrom", "n_bins", "bin_start")
    out = peaks.join(s, "chrom").withColumn("bin", F.expr(f"(p1 + p2) div 2 div {int(resolution)}"))
    out = out.where(F.col("bin").between(F.lit(span), F.col("n_bins") - 1 - span))
    return out.select("chrom", "bin", (F.col("bin_start") + F.col("bin")).alias("gbin"), "feature").distinct()


def windows(peaks: DataFrame, span: int, bad: DataFrame | None = None) -> DataFrame:
    """(gbin, off, p): the good bins p of the window of each distinct peak bin, off counted from the window's start."""
    out = peaks.select("gbin").distinct().withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(2 * span)))).withColumn("p", F.col("gbin") - span + F.col("off"))
    if bad is not None:
        out = out.join(bad.select(F.col("bin").alias("p")), "p", "left_anti")
    return out.select("gbin", "off", "p")


def drop_all_bad(peaks: DataFrame, span: int, bad: DataFrame) -> DataFrame:
    """Peaks with at least one good bin in their window.

    Bad bins are the bits of one number for each 64 bins. A window reaches into one or two such numbers, more where it is wider,
    and is bad throughout if all its bits are set in each of them. Nothing is put in order.
    """
    bits = bad.select(F.expr("bin div 64").alias("block"), F.lit(1).cast("bigint").alias("one"), (F.col("bin") % 64).cast("int").alias("bit"))
    bits = bits.groupBy("block").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    low, high = F.col("gbin") - span, F.col("gbin") + span
    at = peaks.select("gbin").distinct().withColumn("block", F.explode(F.sequence(F.floor(low / 64), F.floor(high / 64))))
    first, last = F.greatest(low, F.col("block") * 64), F.least(high, F.col("block") * 64 + 63)
    at = at.withColumn("from", (first - F.col("block") * 64).cast("int")).withColumn("n", (last - first + 1).cast("int"))
    whole = F.expr("shiftleft(shiftrightunsigned(-1L, 64 - n), `from`)")
    covered = F.coalesce(F.col("bits").bitwiseAND(whole) == whole, F.lit(False))
    lost = at.join(bits, "block", "left").groupBy("gbin").agg(F.bool_and(covered).alias("lost")).where("lost").select("gbin")
    return peaks.join(lost, "gbin", "left_anti").select(*peaks.columns)


def group_domain(first: DataFrame, second: DataFrame | None = None, in_feature: bool = False, both_are_feature: bool = False) -> DataFrame:
    """(grp): all groups a run reports, also those without pairs. second: None in single-list mode."""
    if both_are_feature:
        return first.sparkSession.createDataFrame([("",)], "grp string")
    out = first.select(F.col("feature").alias("grp"))
    if second is not None and not in_feature:
        out = out.union(second.select("feature"))
    return out.distinct()
