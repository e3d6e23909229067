"""Bins of a genome: chromosomes laid end to end, in the order of their `ord`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(chroms: DataFrame, resolution: int) -> DataFrame:
    """(ord, chrom, size_bp) -> also n_bins = size div resolution + 1 and the half-open range bin_start, bin_end of global bins.

    A row for each chromosome, so the running sum over all of them is a small one.
    """
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = chroms.withColumn("n_bins", F.expr(f"size_bp div {int(resolution)} + 1"))
    out = out.withColumn("bin_end", F.sum("n_bins").over(upto))
    return out.withColumn("bin_start", F.col("bin_end") - F.col("n_bins")).select("ord", "chrom", "size_bp", "n_bins", "bin_start", "bin_end")


#: Bins of a block of the table that bins are looked up in.
BLOCK = 64


def locate(df: DataFrame, genome: DataFrame, column: str, chrom: str = "chrom", local: str = "local_bin") -> DataFrame:
    """Adds the chromosome and local bin of a global bin; bins outside the genome are left out.

    Chromosomes are listed under every block of BLOCK bins that they reach into, so the join is one on equal blocks, and a bin is
    compared with the chromosomes of its block alone, however many contigs the genome has. No table of bins is made.
    """
    s = genome.select(F.col("chrom").alias(chrom), "bin_start", "bin_end").where("bin_end > bin_start")
    s = s.withColumn("_block", F.explode(F.sequence(F.expr(f"bin_start div {BLOCK}"), F.expr(f"(bin_end - 1) div {BLOCK}"))))
    out = df.withColumn("_block", F.floor(F.col(column) / BLOCK).cast("bigint")).join(s, "_block")
    out = out.where((F.col(column) >= F.col("bin_start")) & (F.col(column) < F.col("bin_end")))
    return out.withColumn(local, F.col(column) - F.col("bin_start")).drop("bin_start", "bin_end", "_block")


def total_bins(genome: DataFrame) -> int:
    return genome.agg(F.max("bin_end")).first()[0] or 0
