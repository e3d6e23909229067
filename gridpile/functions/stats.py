"""Statistics of waffles, a few numbers for each group: centre, distance decay, rank correlation, line fit, spatial correlation.

All take dense cells (grp, x, y, mean, size, counter) as waffle.mean_over_pairs gives them. A waffle has size^2 cells whatever
the matrix, so the windows below are over small groups, many at a time.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .special import normal_two_sided, spearman_p, t_quantile

SIGNIFICANT = 0.05
POINTS = 1000
#: Significance levels at which hot spots are shown.
HOT_SPOT_LEVELS = (0.01, 0.005, 0.001, 0.0005, 0.0001, 0.00005, 0.00001)


def oriented(cells: DataFrame) -> DataFrame:
    """Row r = y and column c = size - 1 - x, as prediction and plots see a waffle."""
    return cells.withColumn("r", F.col("y")).withColumn("c", F.col("size") - 1 - F.col("x"))


def centre_score(cells: DataFrame, true_centre: bool = False) -> DataFrame:
    """(grp, center): mean of a 3 x 3 block of the oriented waffle. The block's middle is one past the true middle in row and
    column, as results must match; true_centre moves it. Sizes under 5 have no such block and fail the job."""
    small = F.raise_error(F.lit("a waffle needs a size of 5 or more")).cast("int")
    mid = F.when(F.col("size") < 5, small).otherwise(F.col("size")).cast("int")
    mid = F.floor(mid / 2).cast("int") + (0 if true_centre else 1)
    o = oriented(cells).where((F.abs(F.col("r") - mid) <= 1) & (F.abs(F.col("c") - mid) <= 1))
    return o.groupBy("grp").agg((F.sum(F.coalesce("mean", F.lit(0.0))) / 9).alias("center"))


def decay(cells: DataFrame, metric: str = "loop") -> DataFrame:
    """(grp, r, c, dx, dy): closeness sqrt(size) - sqrt(distance to the middle), and the mean's z-score (population deviation).

    normal: one z-score over all cells. loop: the quadrant r, c <= middle and the rest have each their own. No variance, no value.
    """
    mid = F.expr("size div 2")
    o = oriented(cells).withColumn("quadrant", (F.col("r") <= mid) & (F.col("c") <= mid))
    w = Window.partitionBy("grp", *["quadrant"] * (metric == "loop"))
    spread = F.stddev_pop("mean").over(w)
    distance = F.abs(mid - F.col("r")) + F.abs(mid - F.col("c"))
    y = F.when(spread > 0, (F.col("mean") - F.avg("mean").over(w)) / spread)
    return o.select("grp", "r", "c", (F.sqrt(F.col("size").cast("double")) - F.sqrt(distance.cast("double"))).alias("dx"), y.alias("dy"))


def spearman(xy: DataFrame) -> DataFrame:
    """(grp, rho, n): rank correlation of dx and dy with mean ranks for ties; null if either has no variance or a value is missing."""
    def rank(c: str):
        w = Window.partitionBy("grp")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("grp", c)) - 1) / 2

    r = xy.withColumn("rx", rank("dx").cast("double")).withColumn("ry", rank("dy").cast("double"))
    s = r.groupBy("grp").agg(F.covar_pop("rx", "ry").alias("xy"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.count("*").alias("n"), F.count("dy").alias("k"))
    rho = F.when((F.col("sx") > 0) & (F.col("sy") > 0) & (F.col("n") == F.col("k")), F.col("xy") / F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), F.col("sx") * F.col("sy"))))
    return s.select("grp", rho.alias("rho"), "n")


def deming(xy: DataFrame) -> DataFrame:
    """(grp, slope, intercept, r2, n, ...): the line of least orthogonal distance, with deviations var(y) for x and var(x) for y, in closed form."""
    m = xy.where("dx is not null and dy is not null").groupBy("grp").agg(
        F.avg("dx").alias("mx"), F.avg("dy").alias("my"), F.var_pop("dx").alias("sxx"), F.var_pop("dy").alias("syy"), F.covar_pop("dx", "dy").alias("sxy"), F.count("*").alias("n"), F.min("dx").alias("x0"), F.max("dx").alias("x1"))
    d = F.pow(F.try_divide("sxx", "syy"), 2)
    e = F.col("syy") - d * F.col("sxx")
    m = m.withColumn("slope", F.when(F.col("sxy") != 0, F.try_divide(e + F.sqrt(e * e + 4 * d * F.col("sxy") * F.col("sxy")), 2 * F.col("sxy"))))
    m = m.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    # sum of squared errors of y against the line, from the moments
    m = m.withColumn("sse", F.col("n") * (F.col("syy") - 2 * F.col("slope") * F.col("sxy") + F.col("slope") * F.col("slope") * F.col("sxx")))
    return m.withColumn("r2", 1 - F.try_divide(F.col("sse"), F.col("n") * F.col("syy")))


def bands(fit: DataFrame, df: int = 2, confidence: float = 0.95, points: int = POINTS) -> DataFrame:
    """(grp, i, x, y, confidence, prediction): the fitted line at `points` places from 1 % before the data to 1 % after, with half-widths of both bands."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return n.map(lambda v: t_quantile(1 - (1 - confidence) / 2, v - df - 1))

    f = fit.withColumn("t", quantile("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    wide = F.col("x1") - F.col("x0")
    x = F.col("x0") - wide * 0.01 + F.col("i") * (wide * 1.02) / (points - 1)
    f = f.withColumn("x", x).withColumn("mse", F.col("sse") / F.when(F.col("n") > df + 1, F.col("n") - df - 1))
    away = F.try_divide(F.pow(F.col("x") - F.col("mx"), 2), F.col("n") * F.col("sxx"))
    near = F.try_divide(F.lit(1.0), F.col("n")) + away
    return f.select("grp", "i", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"), (F.col("t") * F.sqrt(F.col("mse") * near)).alias("confidence"), (F.col("t") * F.sqrt(F.col("mse") * (1 + near))).alias("prediction"))


def predict(cells: DataFrame, metric: str = "loop") -> DataFrame:
    """(grp, spear, pval, center, test): test is pval < 0.05 and spear > 0 and center > 1. A group without pairs has NaN, NaN, 0, false."""

    @F.pandas_udf("double")
    def p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([spearman_p(float("nan") if r is None else r, int(k)) for r, k in zip(rho, n, strict=True)])

    counter = cells.groupBy("grp").agg(F.max("counter").alias("counter"))
    rho = spearman(decay(cells, metric)).withColumn("pval", p_value(F.coalesce("rho", F.lit(float("nan"))), "n"))
    out = counter.join(rho, "grp").join(centre_score(cells), "grp")
    nan = F.lit(float("nan"))
    empty = F.col("counter") == 0
    out = out.select("grp", F.when(empty, nan).otherwise(F.coalesce("rho", nan)).alias("spear"), F.when(empty, nan).otherwise(F.coalesce("pval", nan)).alias("pval"), F.when(empty, F.lit(0.0)).otherwise(F.col("center")).alias("center"))
    # in Spark NaN exceeds all numbers
    real = ~F.isnan("spear") & ~F.isnan("pval")
    return out.withColumn("test", real & (F.col("pval") < SIGNIFICANT) & (F.col("spear") > 0) & (F.col("center") > 1))


def moran_neighbours(cells: DataFrame, width: int = 2, loop: bool = False) -> DataFrame:
    """(grp, cell, ncell, dist, w): neighbours up to Chebyshev distance width, not itself, inside the waffle. w = value / dist, or
    (1 + 1 / h - dist / h) * value with h = width / 2 for loops; cell = r + c * size with r = y and c = x."""
    a = cells.select("grp", "size", F.col("y").alias("i"), F.col("x").alias("j"), F.col("mean").alias("v"))
    for k in ("di", "dj"):
        a = a.withColumn(k, F.explode(F.sequence(F.lit(-width), F.lit(width))))
    a = a.where("not (di = 0 and dj = 0)").where((F.col("i") + F.col("di")).between(0, F.col("size") - 1) & (F.col("j") + F.col("dj")).between(0, F.col("size") - 1))
    dist = F.greatest(F.abs("di"), F.abs("dj"))
    h = width / 2
    w = (F.lit(1 + 1 / h) - dist / h) * F.col("v") if loop else F.col("v") / dist
    return a.select("grp", (F.col("i") + F.col("j") * F.col("size")).alias("cell"), (F.col("i") + F.col("di") + (F.col("j") + F.col("dj")) * F.col("size")).alias("ncell"), dist.alias("dist"), w.alias("w"))


def _values(cells: DataFrame) -> DataFrame:
    """log2 of the means, centred by group; a group with a mean of 0 or less has none."""
    v = cells.select("grp", (F.col("y") + F.col("x") * F.col("size")).alias("cell"), F.when(F.col("mean") > 0, F.log2("mean")).alias("v"))
    w = Window.partitionBy("grp")
    return v.withColumn("whole", F.count("v").over(w) == F.count("*").over(w)).withColumn("z", F.when(F.col("whole"), F.col("v") - F.avg("v").over(w))).select("grp", "cell", "z")


def _row_weights(cells: DataFrame, width: int, loop: bool) -> DataFrame:
    n = moran_neighbours(cells, width, loop)
    return n.withColumn("w", F.try_divide("w", F.sum("w").over(Window.partitionBy("grp", "cell")))).select("grp", "cell", "ncell", "w")


def moran_global(cells: DataFrame, width: int = 2, loop: bool = False) -> DataFrame:
    """(grp, i, expected, variance, se, z, p): Moran's I of the log2 means with row-standardised weights, moments under randomisation."""

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda v: float("nan") if pd.isna(v) else normal_two_sided(v))

    z = _values(cells)
    w = _row_weights(cells, width, loop)
    back = w.select("grp", F.col("ncell").alias("cell"), F.col("cell").alias("ncell"), F.col("w").alias("wt"))
    pairs = w.join(back, ["grp", "cell", "ncell"], "full_outer").select("grp", "cell", "ncell", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("wt", F.lit(0.0)).alias("wt"))
    lag = pairs.join(z.select("grp", F.col("cell").alias("ncell"), F.col("z").alias("zn")), ["grp", "ncell"])
    per = lag.groupBy("grp", "cell").agg(F.sum(F.col("w") * F.col("zn")).alias("lag"), F.sum("w").alias("row"), F.sum("wt").alias("col"), F.sum(F.pow(F.col("w") + F.col("wt"), 2)).alias("both"))
    t = per.join(z, ["grp", "cell"]).groupBy("grp").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("z") * F.col("lag")).alias("zl"), F.sum(F.col("z") * F.col("z")).alias("z2"), F.sum(F.pow("z", 4)).alias("z4"),
        F.sum("row").alias("s0"), (F.sum("both") / 2).alias("s1"), F.sum(F.pow(F.col("row") + F.col("col"), 2)).alias("s2"))
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    k = F.try_divide(F.col("z4") / n, F.pow(F.col("z2") / n, 2))
    t = t.withColumn("i", F.try_divide(n, s0) * F.try_divide("zl", "z2")).withColumn("expected", -1 / (n - 1))
    a = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
    b = k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    t = t.withColumn("variance", F.try_divide(a - b, (n - 1) * (n - 2) * (n - 3) * s0 * s0) - F.pow("expected", 2))
    t = t.withColumn("se", F.sqrt("variance")).withColumn("z", F.try_divide(F.col("i") - F.col("expected"), F.col("se")))
    return t.select("grp", "i", "expected", "variance", "se", "z", two_sided("z").alias("p"))


def moran_quadrants(cells: DataFrame, width: int = 2, loop: bool = False) -> DataFrame:
    """(grp, cell, local, quadrant): local Moran statistic, and 1 high among high, 2 low among high, 3 low among low, 4 high among low."""
    z = _values(cells)
    lag = _row_weights(cells, width, loop).join(z.select("grp", F.col("cell").alias("ncell"), F.col("z").alias("zn")), ["grp", "ncell"]).groupBy("grp", "cell").agg(F.sum(F.col("w") * F.col("zn")).alias("lag"))
    out = z.join(lag, ["grp", "cell"]).withColumn("m2", F.sum(F.col("z") * F.col("z")).over(Window.partitionBy("grp"))).withColumn("n", F.count("*").over(Window.partitionBy("grp")))
    high, near = F.col("z") > 0, F.col("lag") > 0
    quadrant = F.when(high & near, 1).when(~high & near, 2).when(~high & ~near, 3).when(high & ~near, 4)
    return out.select("grp", "cell", (F.try_divide(F.col("z") * F.col("lag"), F.col("m2")) * (F.col("n") - 1)).alias("local"), quadrant.alias("quadrant"))


#: Cells of a group whose neighbourhoods are drawn together.
MORAN_BLOCK = 8
#: Draws worked on at a time.
MORAN_DRAWS = 1 << 14
_WORD = (1 << 64) - 1
#: The constants of the splitmix64 generator.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def counted_random(seed: int, cell: int, draw: np.ndarray, step: int) -> np.ndarray:
    """The random number of a place in the run, whoever asks for it: splitmix64 of its number."""
    base = ((seed << 46) + (cell << 26)) * GOLDEN & _WORD
    h = (draw.astype(np.uint64) * np.uint64(64) + np.uint64(step)) * np.uint64(GOLDEN) + np.uint64(base)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def drawn_orders(seed: int, cell: int, draw: np.ndarray, m: int, k: int) -> np.ndarray:
    """For each draw k different ones of m things (0 to m - 1) in random order, every order as likely: one random number t of 1 to j
    for each j of m - k + 1 to m, which is put in front, or, if it is there already, j is put behind it."""
    got = np.zeros((len(draw), 0), np.int32)
    for step, j in enumerate(range(m - k + 1, m + 1)):
        t = (counted_random(seed, cell, draw, step) % np.uint64(j)).astype(np.int32) + 1
        same = got == t[:, None]
        there = same.any(axis=1)
        place = np.where(there, same.argmax(axis=1) + 1 if step else 0, 0)
        column = np.arange(step + 1)
        before = np.pad(got, ((0, 0), (0, 1)))
        after = np.pad(got, ((0, 0), (1, 0)))
        got = np.where(column < place[:, None], before, np.where(column == place[:, None], np.where(there, j, t)[:, None], after)).astype(np.int32)
    return got - 1


def moran_local(cells: DataFrame, width: int = 2, loop: bool = False, permutations: int = 9999, seed: int = 1) -> DataFrame:
    """Adds p_sim to the quadrants: how often neighbours drawn at random from the group's other cells, with the weights of the real
    ones in the order of their numbers, give as extreme a value; null where the quadrant is.

    The random numbers depend on seed, cell, draw and step alone, so results do not hang on how cells are dealt out: a task
    has a few cells of a group at a time. A cell has fewer than 64 neighbours, so width is at most 3. Sums within 1e-9 of the real
    one, as a share of the variance, count as equal.
    """
    if (2 * width + 1) ** 2 > 64:
        raise ValueError("width is at most 3")
    z = _values(cells)
    whole = z.where("z is not null").groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "z"))), lambda s: s["z"]).alias("values"))
    near = _row_weights(cells, width, loop).groupBy("grp", "cell").agg(F.array_sort(F.collect_list(F.struct("ncell", "w"))).alias("near"))
    near = near.select("grp", "cell", F.transform("near", lambda s: s["ncell"]).alias("ncells"), F.transform("near", lambda s: s["w"]).alias("weights"))
    blocks = near.groupBy("grp", F.floor(F.col("cell") / MORAN_BLOCK).alias("block")).agg(F.collect_list(F.struct("cell", "ncells", "weights")).alias("cells"))
    tasks = 2 * cells.sparkSession.sparkContext.defaultParallelism
    rows = blocks.join(whole, "grp").repartition(tasks, "grp", "block").select("grp", "values", "cells")

    def run(batches):
        for b in batches:
            for grp, values, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = np.array(values)
                n, near_equal = len(v), 1e-9 * float((v * v).mean())
                out = []
                for c in own:
                    cell, at, w = c["cell"], np.array(c["ncells"]), np.array(c["weights"], float)
                    real = v[cell] * (w * v[at]).sum()
                    larger = 0
                    for first in range(0, permutations, MORAN_DRAWS):
                        drawn = drawn_orders(seed, cell, np.arange(first, min(permutations, first + MORAN_DRAWS)), n - 1, len(at))
                        larger += int((v[cell] * (w * v[drawn + (drawn >= cell)]).sum(axis=1) >= real - near_equal).sum())
                    out.append((cell, (min(larger, permutations - larger) + 1) / (permutations + 1) if near_equal > 0 else None))
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(out), pa.string()), pa.array([c for c, _ in out], pa.int32()), pa.array([p for _, p in out], pa.float64())], ["grp", "cell", "p_sim"])

    sims = rows.mapInArrow(run, "grp string, cell int, p_sim double")
    return moran_quadrants(cells, width, loop).join(sims, ["grp", "cell"], "left")


def hot_spots(local: DataFrame) -> DataFrame:
    """(grp, cell, level, quadrant): a cell for each level that its p_sim meets."""
    level = F.explode(F.array(*[F.lit(x) for x in HOT_SPOT_LEVELS]))
    return local.withColumn("level", level).where("p_sim <= level").select("grp", "cell", "level", "quadrant")


def polar_rings(cells: DataFrame) -> DataFrame:
    """(grp, k, ordinal, value): ring k has the places at distance k from the middle, of a plane that reaches past the waffle's
    edges, in the order in which they are laid around it: walking columns and then rows, they go alternately before and behind
    all so far. Places outside the waffle have no value."""
    o = oriented(cells).select("grp", "size", "r", "c", F.col("mean").alias("value"))
    heads = o.select("grp", "size").distinct()
    mid = F.expr("size div 2")
    plane = heads
    for k in ("i", "j"):
        plane = plane.withColumn(k, F.explode(F.sequence(-mid, F.col("size") + mid - 1)))
    plane = plane.withColumn("k", F.abs(mid - F.col("i")) + F.abs(mid - F.col("j"))).where(F.col("k") < F.col("size"))
    walk = Window.partitionBy("grp", "k").orderBy("i", "j")
    plane = plane.withColumn("t", F.row_number().over(walk) - 1).withColumn("n", F.count("*").over(Window.partitionBy("grp", "k")))
    # the 1st, 3rd, ... go to the front: the last of them comes first
    front = F.expr("(n + 1) div 2")
    plane = plane.withColumn("ordinal", F.when(F.col("t") % 2 == 0, front - 1 - F.expr("t div 2")).otherwise(front + F.expr("t div 2")).cast("int"))
    inside = plane.join(o.select("grp", F.col("r").alias("j"), F.col("c").alias("i"), "value"), ["grp", "i", "j"], "left")
    return inside.select("grp", F.col("k").cast("int").alias("k"), "ordinal", "value")


