"""A genome derived from the star-schema tables: exact in floating point, so sums do not depend on their order."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.contacts import count_contacts, drop_bad, normalise, upper_half
from ..operators.genome import sections
from ..operators.peaks import bin_peaks

RESOLUTION = 10_000
SPAN = 2


def bins(resolution: int = RESOLUTION) -> int:
    """Bins of the five chromosomes; at a finer resolution matrix and pairs grow with the tables."""
    return sum((1_000_000 + 250_000 * k) // resolution + 1 for k in range(5))


BINS = bins()


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by its path. Its schema is read from the files once a session, not by a job for every mention of the table."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def genome(spark: SparkSession, sf_dir: str, resolution: int = RESOLUTION) -> DataFrame:
    """Five chromosomes, one for each region."""
    chroms = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("chrom"), (1_000_000 + 250_000 * F.col("r_regionkey")).cast("bigint").alias("size_bp"))
    return sections(chroms, resolution)


def raw_peaks(spark: SparkSession, sf_dir: str, side: str, features: bool = False) -> DataFrame:
    """Side A: suppliers, feature nation mod 3. Side B: customers, feature market segment."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    if side == "A":
        rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") * 7919 * 131).alias("k"), (F.col("s_nationkey") % 3).cast("string").alias("f"))
    else:
        rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), (F.col("c_custkey") * 104729).alias("k"), F.col("c_mktsegment").alias("f"))
    rows = rows.join(F.broadcast(nation), F.col("n") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    at = (F.col("k") % (1_000_000 + 250_000 * F.col("r_regionkey"))).cast("bigint")
    return rows.select(F.col("r_name").alias("chrom"), at.alias("p1"), at.alias("p2"), (F.col("f") if features else F.lit("")).alias("feature"))


def peaks(spark: SparkSession, sf_dir: str, side: str, features: bool = False, resolution: int = RESOLUTION) -> DataFrame:
    return bin_peaks(raw_peaks(spark, sf_dir, side, features), genome(spark, sf_dir, resolution), resolution, SPAN)


def bad(spark: SparkSession, resolution: int = RESOLUTION) -> DataFrame:
    return spark.range(bins(resolution)).where("id % 37 = 0").select(F.col("id").alias("bin"))


def reads(spark: SparkSession, sf_dir: str, resolution: int = RESOLUTION) -> DataFrame:
    n = bins(resolution)
    return table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % n).alias("a"), ((F.col("l_partkey") * 13 + F.col("l_suppkey") * 7) % n).alias("b"), F.col("l_linenumber").alias("line"))


def bias(spark: SparkSession, resolution: int = RESOLUTION) -> DataFrame:
    return spark.range(bins(resolution)).select(F.col("id").alias("bin"), F.element_at(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0, 4.0)]), (F.col("id") % 4 + 1).cast("int")).alias("b"))


def decay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances 0 to 49 of every chromosome have a factor, a power of two."""
    d = F.broadcast(spark.range(50).select(F.col("id").alias("dist"), F.pow(F.lit(2.0), -(F.col("id") % 3)).alias("d")))
    return genome(spark, sf_dir).select("chrom").join(d)


def contacts(spark: SparkSession, sf_dir: str, with_decay: bool = False, resolution: int = RESOLUTION) -> DataFrame:
    """(bin1, bin2, raw, nrm) without bad bins."""
    clean = drop_bad(upper_half(count_contacts(reads(spark, sf_dir, resolution))), bad(spark, resolution))
    return normalise(clean, bias(spark, resolution), decay_table(spark, sf_dir) if with_decay else None, genome(spark, sf_dir, resolution))
