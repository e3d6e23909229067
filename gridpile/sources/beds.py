"""Peak lists (BED): white-space separated chromosome, two coordinates and, in some lists, a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def has_feature(lines: DataFrame) -> bool:
    """Whether the first line has a fourth column next to two whole numbers. Only that line decides."""
    first = lines.head(1)
    words = first[0].value.split() if first else []
    try:
        return len(words) >= 4 and int(words[1]) + int(words[2]) is not None
    except ValueError:
        return False


def read_peaks(spark: SparkSession, path: str, coordinates_as_feature: bool = False) -> DataFrame:
    """(chrom, p1, p2, feature). Without a fourth column the feature is empty, or 'chrom:p1-p2' as the file writes them."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    w = F.split(F.trim("value"), r"\s+")
    if has_feature(lines):
        feature = w[3]
    else:
        feature = F.concat(w[0], F.lit(":"), w[1], F.lit("-"), w[2]) if coordinates_as_feature else F.lit("")
    return lines.select(w[0].alias("chrom"), w[1].cast("bigint").alias("p1"), w[2].cast("bigint").alias("p2"), feature.alias("feature"))


def count_peaks(spark: SparkSession, path: str) -> int:
    """Lines of a list, usable or not."""
    return spark.read.text(path).count()
