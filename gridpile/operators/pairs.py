"""Pairs of peaks under chromosome and distance predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the peaks of one side are spread over, so that a chromosome's pairs are made by many tasks.
SPLITS = 16


def parse_window(window: str, resolution: int) -> str | tuple[float, float]:
    """'intra', 'inter', 'all', or 'low-high' in bp, given back as bins (not rounded)."""
    if window in ("intra", "inter", "all"):
        return window
    low, high = (int(x) / resolution for x in window.split("-"))
    if low >= high:
        raise ValueError("the window's beginning must be smaller than its end")
    return low, high


def _sides(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    name = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in ("chrom", "bin", "gbin", "feature")])
    return name(first, "a"), name(second, "b")


def _join(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], rest: Column) -> DataFrame:
    """a with b on equal keys and rest. The rows of a are spread over SPLITS parts, to each of which b is copied; the parts are
    a key of the join, so one without other keys is a hash join too."""
    a = a.withColumn("_sa", F.pmod(F.xxhash64("gbin_a", "feature_a"), F.lit(SPLITS)))
    b = b.withColumn("_sb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPLITS - 1).cast("bigint"))))
    on = rest
    for x, y in [*keys, ("_sa", "_sb")]:
        on = on & (F.col(x) == F.col(y))
    return a.join(b, on)


def pair_peaks(first: DataFrame, second: DataFrame, span: int, window: str | tuple[float, float] = "intra", labels: bool = False, max_dist: float | None = None) -> DataFrame:
    """Distinct (g1, g2, what, what_new) of peaks of first with peaks of second; for one list give it twice.

    intra: same chromosome and at least 2 span + 1 bins apart. inter: different chromosomes. all: both. (low, high): intra and
    low < distance <= high. max_dist, in bins, also drops pairs of one chromosome that lie further apart. g1 <= g2 are the global bins; what is the features' concatenation in the lists' order; what_new, with
    labels, names the two places in genome order. The full product of one list with itself is taken, so two features of its
    peaks give both orders of their label.
    """
    a, b = _sides(first, second)
    apart = F.abs(F.col("bin_a") - F.col("bin_b"))
    far = apart >= 2 * span + 1

    def within(a: DataFrame, b: DataFrame, furthest: float, rest: Column) -> DataFrame:
        """Pairs of one chromosome at most furthest apart: they lie in the same stretch of that length or in neighbouring ones."""
        step = max(1, int(furthest))
        a = a.withColumn("_ka", F.expr(f"bin_a div {step}"))
        b = b.withColumn("_kb", F.explode(F.array(*[F.expr(f"bin_b div {step} + {d}") for d in (-1, 0, 1)])))
        return _join(a, b, [("chrom_a", "chrom_b"), ("_ka", "_kb")], rest & (apart <= furthest)).drop("_ka", "_kb")

    if window == "intra" and max_dist is not None:
        found = within(a, b, max_dist, far)
    elif window == "intra":
        found = _join(a, b, [("chrom_a", "chrom_b")], far)
    elif window == "inter":
        found = _join(a, b, [], F.col("chrom_a") != F.col("chrom_b"))
    elif window == "all" and max_dist is not None:
        found = _join(a, b, [], F.col("chrom_a") != F.col("chrom_b")).unionByName(within(a, b, max_dist, far))
    elif window == "all":
        found = _join(a, b, [], (F.col("chrom_a") != F.col("chrom_b")) | far)
    else:
        low, high = window
        found = within(a, b, high if max_dist is None else min(high, max_dist), far & (apart > low))
    turned = F.col("gbin_a") > F.col("gbin_b")
    place = lambda s: F.concat(F.col(f"chrom_{s}"), F.lit(":"), F.col(f"bin_{s}").cast("string"))
    label = F.when(turned, F.concat(place("b"), F.lit("-"), place("a"))).otherwise(F.concat(place("a"), F.lit("-"), place("b"))) if labels else F.lit("")
    return found.select(
        F.least("gbin_a", "gbin_b").alias("g1"), F.greatest("gbin_a", "gbin_b").alias("g2"), F.concat("feature_a", "feature_b").alias("what"), label.alias("what_new")
    ).distinct()


def count_pairs(pairs: DataFrame, both_are_feature: bool = False) -> DataFrame:
    """(grp, counter): pairs of each group, also those that meet no contact."""
    grp = F.lit("") if both_are_feature else F.col("what")
    return pairs.groupBy(grp.alias("grp")).agg(F.count("*").alias("counter"))


def pair_cells(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """(p1, p2, x, y, what, what_new): all good cells of each pair's square. This is pairs x side^2 rows; waffles are made without it."""
    one = windows.select(F.col("gbin").alias("g1"), F.col("off").alias("x"), F.col("p").alias("p1"))
    two = windows.select(F.col("gbin").alias("g2"), F.col("off").alias("y"), F.col("p").alias("p2"))
    return pairs.join(one, "g1").join(two, "g2").select("p1", "p2", "x", "y", "what", "what_new")
