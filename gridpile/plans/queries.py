"""Registered queries of the waffle engine, all on the derived genome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import contacts as C
from ..operators import genome as G
from ..operators import pairs as P
from ..operators import peaks as K
from ..operators import tiles as T
from ..operators import waffle as W
from ..sources.scratch import new_path
from . import fixture as X

S, R = X.SPAN, X.RESOLUTION
RANGE = "100000-400000"
FINE = 1_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _usable(spark: SparkSession, d: str, side: str, features: bool = False) -> DataFrame:
    return K.drop_all_bad(X.peaks(spark, d, side, features), S, X.bad(spark))


def _pairs(spark: SparkSession, d: str, window: str = "intra", features: bool = False, labels: bool = False) -> DataFrame:
    return P.pair_peaks(_usable(spark, d, "A", features), _usable(spark, d, "B", features), S, P.parse_window(window, R), labels)


def _shown(cells: DataFrame) -> DataFrame:
    return cells.select("grp", "x", "y", "sum_nrm", "sqr_nrm", "passage")


def _waffle(spark: SparkSession, d: str, window: str = "intra") -> DataFrame:
    p = _pairs(spark, d, window)
    counter = P.count_pairs(p)
    return _shown(W.waffle(p, X.contacts(spark, d), S)).join(F.broadcast(counter), "grp").drop("grp")


def _dense(spark: SparkSession, d: str, window: str = "intra", features: bool = False) -> DataFrame:
    a, b = _usable(spark, d, "A", features), _usable(spark, d, "B", features)
    p = P.pair_peaks(a, b, S, P.parse_window(window, R))
    head = W.waffle_head(K.group_domain(a, b), p, R, S)
    return W.mean_over_pairs(W.dense(W.waffle(p, X.contacts(spark, d), S), head))


def _r(c: str, places: int = 9) -> F.Column:
    return F.round(c, places).alias(c)


@query
def genome_sections(spark: SparkSession, d: str) -> DataFrame:
    return X.genome(spark, d)


@query
def bin_lookup(spark: SparkSession, d: str) -> DataFrame:
    return G.locate(spark.range(X.BINS).select(F.col("id").alias("bin")), X.genome(spark, d), "bin").select("bin", "chrom", "local_bin")


@query
def peaks_binned(spark: SparkSession, d: str) -> DataFrame:
    return X.peaks(spark, d, "A", True).withColumn("side", F.lit("A")).unionByName(X.peaks(spark, d, "B", True).withColumn("side", F.lit("B")))


@query
def peaks_raw_count(spark: SparkSession, d: str) -> DataFrame:
    return X.raw_peaks(spark, d, "A").select(F.lit("A").alias("side")).union(X.raw_peaks(spark, d, "B").select(F.lit("B"))).groupBy("side").agg(F.count("*").alias("n"))


@query
def windows_masked(spark: SparkSession, d: str) -> DataFrame:
    both = X.peaks(spark, d, "A").unionByName(X.peaks(spark, d, "B"))
    return K.windows(both, S, X.bad(spark)).select("gbin", "off", "p")


@query
def peaks_usable(spark: SparkSession, d: str) -> DataFrame:
    # bins 100 to 110 are bad here too, so some windows are bad throughout
    bad = X.bad(spark).union(spark.range(100, 111).toDF("bin")).distinct()
    return K.drop_all_bad(X.peaks(spark, d, "A").unionByName(X.peaks(spark, d, "B")).distinct(), S, bad).select("chrom", "bin", "gbin")


@query
def contacts_count(spark: SparkSession, d: str) -> DataFrame:
    return C.count_contacts(X.reads(spark, d))


@query
def contacts_read_filter(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose line number, as filter bits, has none of filters 1 and 3."""
    return C.count_contacts(C.drop_filtered(X.reads(spark, d), (1, 3), "line"))


@query
def contacts_normalised(spark: SparkSession, d: str) -> DataFrame:
    return X.contacts(spark, d, with_decay=True)


def _window(window: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        w = P.parse_window(window, R)
        return C.in_window(X.contacts(spark, d), w, X.genome(spark, d))
    return run


for _name, _w in (("all", "all"), ("intra", "intra"), ("inter", "inter"), ("range", RANGE)):
    QUERIES[f"contacts_window_{_name}"] = _window(_w)
    QUERIES[f"pairs_{_name}"] = lambda spark, d, w=_w: _pairs(spark, d, w).select("g1", "g2")
    QUERIES[f"waffle_{_name}"] = lambda spark, d, w=_w: _waffle(spark, d, w)


@query
def waffle_fine(spark: SparkSession, d: str) -> DataFrame:
    """The waffle at ten times the resolution: its matrix and its pairs grow with the tables."""
    bad = X.bad(spark, FINE)
    a, b = (K.drop_all_bad(X.peaks(spark, d, side, resolution=FINE), S, bad) for side in "AB")
    p = P.pair_peaks(a, b, S)
    cells = W.waffle(p, X.contacts(spark, d, resolution=FINE), S)
    return _shown(cells).join(F.broadcast(P.count_pairs(p)), "grp").drop("grp")


@query
def waffle_stored(spark: SparkSession, d: str) -> DataFrame:
    """The waffle over a matrix that lies in buckets of tiles; its contacts are not moved."""
    path = new_path(spark, "tiles")
    T.write_tiles(X.contacts(spark, d), path, buckets=8)
    p = _pairs(spark, d)
    return _shown(T.stored_waffle(p, *T.open_tiles(spark, path), S)).join(F.broadcast(P.count_pairs(p)), "grp").drop("grp")


@query
def pairs_self(spark: SparkSession, d: str) -> DataFrame:
    """One list with features against itself: both orders of a label of two features occur."""
    one = _usable(spark, d, "A", True)
    return P.pair_peaks(one, one, S).select("g1", "g2", "what")


@query
def pairs_feature_labels(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, features=True, labels=True)


@query
def pair_counter(spark: SparkSession, d: str) -> DataFrame:
    a, b = _usable(spark, d, "A", True), _usable(spark, d, "B", True)
    return W.waffle_head(K.group_domain(a, b), P.pair_peaks(a, b, S), R, S)


@query
def pair_cells(spark: SparkSession, d: str) -> DataFrame:
    both = _usable(spark, d, "A").unionByName(_usable(spark, d, "B"))
    return P.pair_cells(_pairs(spark, d), K.windows(both, S, X.bad(spark))).select("p1", "p2", "x", "y")


@query
def waffle_by_feature(spark: SparkSession, d: str) -> DataFrame:
    return _shown(W.waffle(_pairs(spark, d, features=True), X.contacts(spark, d), S))


@query
def waffle_first_is_feature(spark: SparkSession, d: str) -> DataFrame:
    """Each place of the first list is a group of its own; groups without contacts are there with empty sums."""
    raw = X.raw_peaks(spark, d, "A").withColumn("feature", F.format_string("%s:%d-%d", "chrom", "p1", "p2"))
    a = K.drop_all_bad(K.bin_peaks(raw, X.genome(spark, d), R, S), S, X.bad(spark))
    p = P.pair_peaks(a, _usable(spark, d, "B"), S)
    head = W.waffle_head(K.group_domain(a, in_feature=True), p, R, S)
    cells = W.waffle(p, X.contacts(spark, d), S).groupBy("grp").agg(F.sum("sum_nrm").alias("sum_nrm"), F.sum("passage").alias("passage"))
    return head.join(cells, "grp", "left").select("grp", "counter", F.coalesce("sum_nrm", F.lit(0.0)).alias("sum_nrm"), F.coalesce("passage", F.lit(0)).cast("bigint").alias("passage"))


@query
def waffle_both_features(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of features in one group; pairs that differ only in a label count each."""
    return _shown(W.waffle(_pairs(spark, d, features=True), X.contacts(spark, d), S, both_are_feature=True))


@query
def submatrix_keyed(spark: SparkSession, d: str) -> DataFrame:
    return W.keyed_rows(W.match_cells(_pairs(spark, d, RANGE, features=False, labels=True), X.contacts(spark, d), S), S)


@query
def submatrix_cells(spark: SparkSession, d: str) -> DataFrame:
    return W.submatrix_rows(W.match_cells(_pairs(spark, d, RANGE), X.contacts(spark, d), S), X.genome(spark, d)).drop("what_new")


@query
def waffle_raw(spark: SparkSession, d: str) -> DataFrame:
    return W.waffle(_pairs(spark, d), X.contacts(spark, d), S, with_raw=True).select("x", "y", "sum_raw", "sqr_raw")


@query
def waffle_dense(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, features=True).select("grp", "x", "y", "sum_nrm", "sqr_nrm", "passage", "counter")


@query
def waffle_mean_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("x", "y", _r("mean"))


@query
def waffle_mean_observed(spark: SparkSession, d: str) -> DataFrame:
    return W.mean_over_observed(W.waffle(_pairs(spark, d), X.contacts(spark, d), S)).select("x", "y", _r("mean"))


def _halves(spark: SparkSession, d: str) -> tuple[list[DataFrame], list[DataFrame]]:
    a, b = _usable(spark, d, "A", True), _usable(spark, d, "B", True)
    p, m = P.pair_peaks(a, b, S), X.contacts(spark, d)
    parts = [p.where(f"g1 % 2 = {k}") for k in (0, 1)]
    return [W.waffle(x, m, S) for x in parts], [W.waffle_head(K.group_domain(a, b), x, R, S) for x in parts]


@query
def waffle_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over disjoint pairs, added: equal to one run over all, counters included."""
    cells, heads = _halves(spark, d)
    return _shown(W.merge_cells(*cells)).join(W.merge_heads(*heads).select("grp", "counter"), "grp")


@query
def waffle_merge_split(spark: SparkSession, d: str) -> DataFrame:
    """One group of the merged waffles, as its own folder holds it."""
    cells, _ = _halves(spark, d)
    return _shown(W.merge_cells(*cells)).where("grp = '0BUILDING'")


@query
def waffle_compact(spark: SparkSession, d: str) -> DataFrame:
    return W.compact(W.waffle(_pairs(spark, d), X.contacts(spark, d), S)).drop("grp")


@query
def waffle_windows_total(spark: SparkSession, d: str) -> DataFrame:
    m = X.contacts(spark, d)
    out = None
    for w in ("intra", "0-300000", "300000-600000", "600000-3000000"):
        t = W.total(W.waffle(_pairs(spark, d, w), m, S)).withColumn("window", F.lit(w))
        out = t if out is None else out.unionByName(t)
    return out


@query
def center_score(spark: SparkSession, d: str) -> DataFrame:
    return stats.centre_score(_dense(spark, d, features=True).where("counter > 0")).select("grp", _r("center"))


@query
def decay_normal(spark: SparkSession, d: str) -> DataFrame:
    return stats.decay(_dense(spark, d), "normal").select("r", "c", _r("dx"), _r("dy", 7))


@query
def decay_loop(spark: SparkSession, d: str) -> DataFrame:
    return stats.decay(_dense(spark, d), "loop").select("r", "c", _r("dx"), _r("dy", 7))


@query
def spearman_rho(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(stats.decay(_dense(spark, d), "loop")).select(_r("rho"), F.col("n"))


@query
def fit_deming(spark: SparkSession, d: str) -> DataFrame:
    return stats.deming(stats.decay(_dense(spark, d), "normal")).select(_r("slope", 5), _r("intercept", 5))


@query
def fit_r2(spark: SparkSession, d: str) -> DataFrame:
    return stats.deming(stats.decay(_dense(spark, d), "normal")).select(_r("r2", 5))


@query
def fit_bands(spark: SparkSession, d: str) -> DataFrame:
    b = stats.bands(stats.deming(stats.decay(_dense(spark, d), "normal")))
    return b.select("grp", F.col("i").cast("int").alias("i"), _r("x"), _r("y", 5), _r("confidence", 5), _r("prediction", 5))


def _predicted(spark: SparkSession, d: str, metric: str) -> DataFrame:
    """The prediction of all groups; what has no number, as in groups without pairs, is shown as null."""
    p = stats.predict(_dense(spark, d, features=True), metric)
    number = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), 7).alias(c)
    return p.select("grp", number("spear"), number("pval"), _r("center"), "test")


@query
def predict(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, "loop")


@query
def predict_normal(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, "normal")


@query
def moran_weights(spark: SparkSession, d: str) -> DataFrame:
    return stats.moran_neighbours(_dense(spark, d)).select("cell", "ncell", "dist", _r("w"))


@query
def moran_weights_loop(spark: SparkSession, d: str) -> DataFrame:
    return stats.moran_neighbours(_dense(spark, d), loop=True).select("cell", "ncell", "dist", _r("w"))


@query
def moran_quadrants_loop(spark: SparkSession, d: str) -> DataFrame:
    return stats.moran_quadrants(_dense(spark, d), loop=True).select("cell", _r("local", 6), "quadrant")


@query
def pairs_max_dist(spark: SparkSession, d: str) -> DataFrame:
    """Intra-chromosome pairs no more than 40 bins apart."""
    return P.pair_peaks(_usable(spark, d, "A"), _usable(spark, d, "B"), S, max_dist=40).select("g1", "g2")


@query
def predict_scores(spark: SparkSession, d: str) -> DataFrame:
    """What the prediction is made from: rank correlation and centre of all groups with pairs."""
    p = stats.predict(_dense(spark, d, features=True).where("counter > 0"))
    return p.select("grp", F.round(F.when(F.isnan("spear"), None).otherwise(F.col("spear")), 7).alias("spear"), _r("center"))


@query
def moran_global(spark: SparkSession, d: str) -> DataFrame:
    return stats.moran_global(_dense(spark, d)).select(_r("i", 7), _r("expected"), _r("variance", 7), _r("z", 5))


@query
def moran_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return stats.moran_quadrants(_dense(spark, d)).select("cell", _r("local", 6), "quadrant")


@query
def moran_local(spark: SparkSession, d: str) -> DataFrame:
    return stats.moran_local(_dense(spark, d)).select("cell", _r("local", 6), "quadrant", _r("p_sim"))


@query
def moran_hot_spots(spark: SparkSession, d: str) -> DataFrame:
    return stats.hot_spots(stats.moran_local(_dense(spark, d))).select("cell", "level", "quadrant")


@query
def polar_rings(spark: SparkSession, d: str) -> DataFrame:
    return stats.polar_rings(_dense(spark, d)).select("k", "ordinal", _r("value"))
