"""Rules of the engine on small tables made by hand."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gridpile.functions import special, stats
from gridpile.functions.text import human_bp, python_rounded, rotate
from gridpile.operators import contacts as C
from gridpile.operators import genome as G
from gridpile.operators import pairs as P
from gridpile.operators import peaks as K
from gridpile.operators import waffle as W
from gridpile.sources import beds, matrices, sizes, waffles
from gridpile.streaming import increments

#: Two lists of peaks on three chromosomes of 500, 300 and 200 bins, made up for these tests.
GENOME = [(0, "1", 4_999_999), (1, "2", 2_999_999), (2, "3", 1_999_999)]
RES = 10_000


@pytest.fixture(scope="module")
def genome(spark):
    return G.sections(spark.createDataFrame(GENOME, "ord int, chrom string, size_bp bigint"), RES).cache()


def peaks(spark, rows):
    return spark.createDataFrame([(c, p1, p2, f) for c, p1, p2, f in rows], "chrom string, p1 bigint, p2 bigint, feature string")


def made_peaks(seed, n):
    r = random.Random(seed)
    return [(c, at := r.randrange(size), at + r.randrange(-500, 500), "") for c, size in ((x[1], x[2]) for x in r.choices(GENOME, k=n))]


def made_contacts(spark, seed, n, bins=1000):
    r = random.Random(seed)
    cells = {}
    for _ in range(n):
        a = r.randrange(bins)
        b = min(bins - 1, max(0, a + r.randrange(-120, 120)))
        cells[min(a, b), max(a, b)] = (r.randrange(1, 9), r.randrange(1, 64) / 16)
    return spark.createDataFrame([(a, b, x, y) for (a, b), (x, y) in cells.items()], "bin1 bigint, bin2 bigint, raw bigint, nrm double"), cells


def test_sections(genome, spark):
    assert [(r.bin_start, r.bin_end) for r in genome.orderBy("ord").collect()] == [(0, 500), (500, 800), (800, 1000)]
    got = G.locate(spark.createDataFrame([(817,), (499,), (500,), (1000,)], "b bigint"), genome, "b").collect()
    assert {(r.b, r.chrom, r.local_bin) for r in got} == {(817, "3", 17), (499, "1", 499), (500, "2", 0)}
    assert G.total_bins(genome) == 1000


def test_usable_peaks(spark, genome):
    """The window must fit, ends may be swapped, unknown chromosomes go, repeats count once, features keep apart."""
    rows = [("1", 20_000, 20_000, "a"), ("1", 19_999, 19_999, "a"), ("1", 60_000, 40_000, "b"), ("1", 51_000, 52_000, "b"), ("1", 50_000, 50_000, "c"), ("9", 50_000, 50_000, ""), ("3", 1_979_999, 1_979_999, ""), ("3", 1_980_000, 1_980_000, "")]
    got = {(r.chrom, r.bin, r.gbin, r.feature) for r in K.bin_peaks(peaks(spark, rows), genome, RES, 2).collect()}
    assert got == {("1", 2, 2, "a"), ("1", 5, 5, "b"), ("1", 5, 5, "c"), ("3", 197, 997, "")}


def test_bad_windows(spark, genome):
    p = K.bin_peaks(peaks(spark, [("1", 100_000, 100_000, ""), ("1", 150_000, 150_000, "")]), genome, RES, 2)
    bad = spark.createDataFrame([(b,) for b in (8, 9, 10, 11, 12, 13)], "bin bigint")
    assert [r.gbin for r in K.drop_all_bad(p, 2, bad).collect()] == [15]
    w = {(r.gbin, r.off, r.p) for r in K.windows(p, 2, bad).collect()}
    assert w == {(15, o, 13 + o) for o in range(1, 5)}


def brute_pairs(a, b, span, window):
    out = set()
    for (c1, b1, g1, f1), (c2, b2, g2, f2) in itertools.product(a, b):
        d = abs(b1 - b2)
        near = c1 == c2 and d >= 2 * span + 1
        ok = {"intra": near, "inter": c1 != c2, "all": near or c1 != c2}[window] if isinstance(window, str) else near and window[0] < d <= window[1]
        if ok:
            out.add((min(g1, g2), max(g1, g2), f1 + f2))
    return out


@pytest.mark.parametrize("window", ["intra", "inter", "all", (0.0, 100.0), (10.5, 37.25)])
def test_pairs(spark, genome, window):
    a, b = (K.bin_peaks(peaks(spark, made_peaks(s, 40)), genome, RES, 4) for s in (1, 2))
    rows = [{(r.chrom, r.bin, r.gbin, r.feature) for r in x.collect()} for x in (a, b)]
    got = P.pair_peaks(a, b, 4, window).collect()
    assert {(r.g1, r.g2, r.what) for r in got} == brute_pairs(*rows, 4, window) and len(got) == len(set(got))


def test_salted_pairs_equal_broadcast_pairs(spark, genome, monkeypatch):
    a, b = (K.bin_peaks(peaks(spark, made_peaks(s, 30)), genome, RES, 2) for s in (3, 4))
    plain = set(P.pair_peaks(a, b, 2).collect())

    monkeypatch.setattr(P, "SPLITS", 3)
    assert set(P.pair_peaks(a, b, 2).collect()) == plain


def test_one_list_keeps_both_labels(spark, genome):
    one = K.bin_peaks(peaks(spark, [("1", 100_000, 100_000, "x"), ("1", 300_000, 300_000, "y")]), genome, RES, 2)
    assert {(r.what, r.what_new) for r in P.pair_peaks(one, one, 2, labels=True).collect()} == {("xy", "1:10-1:30"), ("yx", "1:10-1:30")}


def test_window_text():
    assert P.parse_window("0-1000000", RES) == (0.0, 100.0) and P.parse_window("inter", RES) == "inter"
    with pytest.raises(ValueError):
        P.parse_window("5-5", RES)


@pytest.fixture(scope="module")
def scene(spark, genome):
    a, b = (K.bin_peaks(peaks(spark, made_peaks(s, 60)), genome, RES, 3) for s in (5, 6))
    contacts, cells = made_contacts(spark, 7, 20_000)
    bad = spark.createDataFrame([(b,) for b in range(0, 1000, 29)], "bin bigint")
    contacts = C.drop_bad(contacts, bad).cache()
    return a.cache(), b.cache(), contacts, bad, {k: v for k, v in cells.items() if k[0] % 29 and k[1] % 29}


def test_waffle_equals_brute_force_and_key_join(spark, scene):
    a, b, contacts, bad, cells = scene
    pairs = P.pair_peaks(a, b, 3, "all").cache()
    want = {}
    for r in pairs.collect():
        for x, y in itertools.product(range(7), range(7)):
            hit = cells.get((r.g1 - 3 + x, r.g2 - 3 + y))
            if hit:
                s = want.setdefault((x, y), [0, 0.0, 0.0, 0])
                s[0] += hit[0]
                s[1] += hit[1]
                s[2] += hit[1] ** 2
                s[3] += 1
    got = {(r.x, r.y): [r.sum_raw, r.sum_nrm, r.sqr_nrm, r.passage] for r in W.waffle(pairs, contacts, 3, with_raw=True).collect()}
    assert got == want
    by_key = W.waffle_cells(W.match_cells_by_key(pairs, contacts, K.windows(a.union(b), 3, bad)), with_raw=True)
    assert {(r.x, r.y): [r.sum_raw, r.sum_nrm, r.sqr_nrm, r.passage] for r in by_key.collect()} == want


def test_windows_add_up(spark, scene):
    a, b, contacts, _, _ = scene
    one = lambda w: W.total(W.waffle(P.pair_peaks(a, b, 3, w), contacts, 3)).first()
    parts = [one((x, x + 100.0)) for x in (0.0, 100.0, 200.0, 300.0, 400.0)]
    whole = one("intra")
    assert whole.total == sum(p.total for p in parts) and whole.passage == sum(p.passage for p in parts)
    assert one("all").passage == whole.passage + one("inter").passage


def test_merge_of_parts_is_the_whole(spark, scene):
    a, b, contacts, _, _ = scene
    pairs = P.pair_peaks(a, b, 3)
    parts = [pairs.where(f"g1 % 3 = {k}") for k in range(3)]
    key = lambda df: {tuple(r) for r in df.select(sorted(df.columns)).collect()}
    assert key(W.merge_cells(*[W.waffle(p, contacts, 3) for p in parts])) == key(W.waffle(pairs, contacts, 3))
    domain = K.group_domain(a, b)
    heads = [W.waffle_head(domain, p, RES, 3) for p in parts]
    assert key(W.merge_heads(*heads)) == key(W.waffle_head(domain, pairs, RES, 3))
    with pytest.raises(Exception, match="can't be merged"):
        W.merge_heads(heads[0], heads[1].withColumn("size", F.lit(9))).collect()


def test_pairs_without_contacts_count(spark, genome):
    one = K.bin_peaks(peaks(spark, [("1", 100_000, 100_000, "x"), ("1", 300_000, 300_000, "y"), ("2", 300_000, 300_000, "z")]), genome, RES, 2)
    pairs = P.pair_peaks(one, one, 2)
    none = spark.createDataFrame([], "bin1 bigint, bin2 bigint, raw bigint, nrm double")
    head = W.waffle_head(K.group_domain(one), pairs, RES, 2)
    assert {(r.grp, r.counter) for r in head.collect()} == {("x", 0), ("y", 0), ("z", 0), ("xy", 1), ("yx", 1)}
    d = W.dense(W.waffle(pairs, none, 2), head)
    assert d.count() == 5 * 25 and d.where("sum_nrm <> 0 or passage <> 0").count() == 0
    assert {r.test for r in stats.predict(W.mean_over_pairs(d)).collect()} == {False}


def test_normalise(spark, genome):
    m = spark.createDataFrame([(1, 2, 8), (1, 600, 8), (3, 3, 8)], "bin1 bigint, bin2 bigint, raw bigint")
    bias = spark.createDataFrame([(1, 2.0), (2, 2.0), (600, 4.0)], "bin bigint, b double")
    decay = spark.createDataFrame([("1", 1, 0.5), ("1", 599, 0.5)], "chrom string, dist bigint, d double")
    assert {(r.bin2, r.nrm) for r in C.normalise(m, bias, decay, genome, check=False).collect()} == {(2, 4.0), (600, 1.0)}
    with pytest.raises(Exception, match="no bias for a bin of contact 3, 3"):
        C.normalise(m, bias, decay, genome).collect()
    assert C.filter_mask((1, 3)) == 5 and C.in_window(m, (0, 1)).count() == 2


def mean_cells(spark, matrix):
    """A waffle's dense cells from its oriented matrix: row y, column size - 1 - x."""
    n = len(matrix)
    return spark.createDataFrame([("g", n - 1 - c, r, float(matrix[r][c]), n, 1) for r in range(n) for c in range(n)], "grp string, x int, y int, mean double, size int, counter bigint")


def test_centre(spark):
    m = [[r * 10 + c for c in range(5)] for r in range(5)]
    assert stats.centre_score(mean_cells(spark, m)).first().center == 33
    assert stats.centre_score(mean_cells(spark, m), true_centre=True).first().center == 22
    with pytest.raises(Exception, match="a size of 5 or more"):
        stats.centre_score(mean_cells(spark, [[1] * 3] * 3)).collect()


@pytest.mark.parametrize("metric", ["normal", "loop"])
def test_decay_and_rank_correlation(spark, metric):
    import numpy as np

    r = np.random.default_rng(3)
    m = r.integers(1, 6, (7, 7)).astype(float)
    x = np.array([[math.sqrt(7) - math.sqrt(abs(3 - i) + abs(3 - j)) for j in range(7)] for i in range(7)])
    z = lambda v: (v - v.mean()) / v.std()
    quadrant = np.array([[i <= 3 and j <= 3 for j in range(7)] for i in range(7)])
    y = z(m) if metric == "normal" else np.where(quadrant, (m - m[quadrant].mean()) / m[quadrant].std(), (m - m[~quadrant].mean()) / m[~quadrant].std())
    got = stats.decay(mean_cells(spark, m), metric)
    for row in got.collect():
        assert abs(row.dx - x[row.r, row.c]) < 1e-12 and abs(row.dy - y[row.r, row.c]) < 1e-9
    import pandas as pd

    want = pd.Series(x.ravel()).rank().corr(pd.Series(y.ravel().round(9)).rank())
    assert abs(stats.spearman(got.withColumn("dy", F.round("dy", 9))).first().rho - want) < 1e-9


def test_constant_waffle_is_not_significant(spark):
    d = mean_cells(spark, [[2] * 5] * 5)
    row = stats.predict(d).first()
    assert math.isnan(row.spear) and math.isnan(row.pval) and row.center == 2 and row.test is False


def test_line_fit_of_exact_line(spark):
    xy = spark.createDataFrame([("g", float(x), 3.0 * x - 1) for x in range(10)], "grp string, dx double, dy double")
    f = stats.deming(xy).first()
    assert abs(f.slope - 3) < 1e-9 and abs(f.intercept + 1) < 1e-9 and abs(f.r2 - 1) < 1e-9
    b = stats.bands(stats.deming(xy)).collect()
    assert len(b) == 1000 and all(abs(r.y - (3 * r.x - 1)) < 1e-6 and r.confidence < 1e-3 for r in b)
    flat = spark.createDataFrame([("g", float(x), 1.0) for x in range(4)], "grp string, dx double, dy double")
    assert stats.deming(flat).first().slope is None


def test_t_points():
    """Two-sided 5 % points and others of the t table."""
    for dof, t in ((1, 12.706), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980)):
        assert abs(special.t_quantile(0.975, dof) - t) < 6e-4
        assert abs(special.t_two_sided(t, dof) - 0.05) < 1e-4
    assert abs(special.t_quantile(0.025, 10) + special.t_quantile(0.975, 10)) < 1e-12
    assert math.isnan(special.spearman_p(float("nan"), 10)) and special.spearman_p(1.0, 10) == 0
    assert abs(special.normal_two_sided(1.959964) - 0.05) < 1e-6


def test_moran_of_a_gradient_and_a_board(spark):
    smooth = mean_cells(spark, [[2.0 ** (r + c) for c in range(5)] for r in range(5)])
    board = mean_cells(spark, [[2.0 + 6 * ((r + c) % 2) for c in range(5)] for r in range(5)])
    s, b = stats.moran_global(smooth).first(), stats.moran_global(board).first()
    assert s.i > 0.3 and s.z > 2 and s.p < 0.05 and b.i < s.expected
    local = stats.moran_local(smooth, permutations=199).collect()
    assert len(local) == 25 and {r.quadrant for r in local} <= {1, 2, 3, 4} and all(0 < r.p_sim <= 1 for r in local)
    zero = mean_cells(spark, [[0.0] + [1.0] * 4] + [[1.0] * 5] * 4)
    assert stats.moran_global(zero).first().i is None


def test_polar_order(spark):
    m = [[r * 10 + c for c in range(3)] for r in range(3)]
    d = mean_cells(spark, m)
    want = {}
    for k in range(3):
        tmp = []
        for i in range(-1, 4):
            for j in range(-1, 4):
                if abs(1 - i) + abs(1 - j) == k:
                    v = float(m[j][i]) if 0 <= i < 3 and 0 <= j < 3 else None
                    tmp.insert(0, v) if len(tmp) % 2 == 0 else tmp.append(v)
        want |= {(k, o): v for o, v in enumerate(tmp)}
    assert {(r.k, r.ordinal): r.value for r in stats.polar_rings(d).collect()} == want


def test_bed_forms(spark, tmp_path):
    (tmp_path / "f.bed").write_text("1\t30\t10\tx\textra\n2 5 7 y\n")
    (tmp_path / "n.bed").write_text("1\t0030\t10\n")
    assert [tuple(r) for r in beds.read_peaks(spark, str(tmp_path / "f.bed")).collect()] == [("1", 30, 10, "x"), ("2", 5, 7, "y")]
    assert beds.read_peaks(spark, str(tmp_path / "n.bed")).first().feature == ""
    assert beds.read_peaks(spark, str(tmp_path / "n.bed"), True).first().feature == "1:0030-10"
    assert beds.count_peaks(spark, str(tmp_path / "f.bed")) == 2


def test_matrix_text(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("# CHROM\t1\t4999999\n# CHROM\t2\t2999999\n# RESOLUTION\t10000\n# BADCOLS\t3,9\n1\t2\t5\t0.5\n2\t2\t1\t1e-05\n")
    h = matrices.read_header(spark, str(p))
    assert (h.chroms, h.resolution, h.bad) == ([("1", 4999999), ("2", 2999999)], 10000, [3, 9])
    assert [tuple(r) for r in matrices.read_matrix(spark, str(p)).collect()] == [(1, 2, 5, 0.5), (2, 2, 1, 1e-05)]
    assert matrices.parse_header(["# CHROM\t1\t5", "# RESOLUTION\t2", "# BADCOLS\t"]).bad == []
    for wrong in (["# NAME\t1\t5"], ["# CHROM\t1\t5", "# BADCOLS\t", "# RESOLUTION\t2"]):
        with pytest.raises(matrices.BadHeader):
            matrices.parse_header(wrong)
    (tmp_path / "bad.tsv").write_text("1\tx\t3\t0.5\n")
    with pytest.raises(Exception):
        matrices.read_matrix(spark, str(tmp_path / "bad.tsv")).collect()
    m = matrices.read_matrix(spark, str(p))
    matrices.write_matrix(m, str(tmp_path / "m.parquet"))
    assert spark.read.parquet(str(tmp_path / "m.parquet")).count() == 2
    with pytest.raises(ValueError):
        matrices.check_unique(m.union(m))


def test_sizes(spark, tmp_path, genome):
    (tmp_path / "g.fa").write_text(">c1 first\nACGT\nAC\n>c2\nA\n>c3\nACG")
    assert [(r.ord, r.chrom, r.size_bp) for r in sizes.fasta_sizes(spark, str(tmp_path / "g.fa")).orderBy("ord").collect()] == [(0, "c1", 6), (1, "c2", 1), (2, "c3", 3)]
    (tmp_path / "s.txt").write_text("2\t100\n1\t50\n")
    assert [r.chrom for r in sizes.read_sizes(spark, str(tmp_path / "s.txt")).orderBy("ord").collect()] == ["2", "1"]
    (tmp_path / "r.sam").write_text("@SQ\tSN:1\tLN:4999999\nr1\t65\t1\t10001\t60\t5M\t=\t20001\t0\t*\t*\nr1\t129\t1\t20001\t60\t5M\t=\t10001\t0\t*\t*\nr2\t65\t2\t1\t60\t5M\t1\t1\t0\t*\t*\n")
    got = {(r.a, r.b) for r in sizes.sam_contacts(spark, str(tmp_path / "r.sam"), genome, RES).collect()}
    assert got == {(1, 2), (500, 0)} and sizes.sam_sizes(spark, str(tmp_path / "r.sam")).first().size_bp == 4999999


def test_waffle_files(spark, scene, tmp_path):
    a, b, contacts, _, _ = scene
    pairs = P.pair_peaks(a, b, 3)
    cells, head = W.waffle(pairs, contacts, 3), W.waffle_head(K.group_domain(a, b), pairs, RES, 3)
    waffles.write_waffle(cells, head, str(tmp_path / "w"))
    c, h, missed = waffles.merge_files(spark, [str(tmp_path / "w"), str(tmp_path / "none"), str(tmp_path / "w")])
    assert missed == [str(tmp_path / "none")] and h.first().counter == 2 * head.first().counter
    assert W.total(c).first().total == 2 * W.total(cells).first().total
    waffles.write_split(cells, head, str(tmp_path / "s"))
    waffles.write_split(cells, head, str(tmp_path / "s"))
    assert W.total(waffles.read_split(spark, str(tmp_path / "s"))[0]).first().total == 2 * W.total(cells).first().total
    waffles.write_text(cells, head, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    assert text.splitlines()[4] == f">\t{RES}\t7\t{head.first().counter}" and len(text.splitlines()[5].split("\t")) == 49
    back, heads = waffles.read_text(spark, str(tmp_path / "t"))
    assert heads.first().counter == head.first().counter
    assert {(r.x, r.y): round(r.sum_nrm, 3) for r in back.collect()} == {(r.x, r.y): round(r.sum_nrm, 3) for r in cells.collect()}
    waffles.write_submatrices(W.submatrix_rows(W.match_cells(pairs, contacts, 3), G.sections(spark.createDataFrame(GENOME, "ord int, chrom string, size_bp bigint"), RES)), str(tmp_path / "sub"))
    assert len(next((tmp_path / "sub").glob("part*")).read_text().splitlines()[0].split("\t")) == 9


def test_stream_equals_batch(spark, scene, tmp_path):
    a, b, contacts, _, _ = scene
    pairs = P.pair_peaks(a, b, 3)
    contacts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(contacts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = increments.stream_waffle(stream, pairs, 3, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    want = {(r.x, r.y): (r.sum_nrm, r.passage) for r in W.waffle(pairs, contacts, 3).collect()}
    assert {(r.x, r.y): (r.sum_nrm, r.passage) for r in increments.read_increments(spark, str(tmp_path / "out")).collect()} == want


def test_numbers_as_text(spark):
    values = [1.0005, 0.0005, 0.1235, 1e-5, 12.0, 2.5e20]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(python_rounded("v").alias("t")).collect()
    assert [r.t for r in got] == [str(round(v, 3)) for v in values]
    bp = [0, 500, 1000, 125_000, 1_900_000, 3_000_000, 2_000_000_000]
    rows = spark.createDataFrame([(v,) for v in bp], "v bigint")
    assert [r.t for r in rows.select(human_bp(F.col("v")).alias("t")).collect()] == ["0 b", "500 b", "1 kb", "125 kb", "1900 kb", "3 Mb", "2 Gb"]
    assert rows.where("v = 1900000").select(human_bp(F.col("v"), allowed_decimals=1).alias("t")).first().t == "1.9 Mb"
    assert spark.range(1).select(rotate(F.array(*[F.lit(i) for i in range(4)]), 1).alias("a")).first().a == [3, 0, 1, 2]


def test_moran_queries_run_the_operators_own_permutations(spark, monkeypatch):
    """With 9,999 permutations p_sim can meet every level of hot spots."""
    from gridpile.plans import queries

    lone = mean_cells(spark, [[2.0 ** ((r * 5 + c) * (r * 5 + c) % 7 + 6 * (r < 2 and c < 2)) for c in range(5)] for r in range(5)])
    monkeypatch.setattr(queries, "_dense", lambda spark, d: lone)
    want = {r.cell: r.p_sim for r in stats.moran_local(lone, permutations=9999).collect()}
    assert {r.cell: r.p_sim for r in queries.moran_local(spark, "").collect()} == want
    spots = {(r.cell, r.level) for r in queries.moran_hot_spots(spark, "").collect()}
    assert spots == {(c, x) for c, p in want.items() for x in stats.HOT_SPOT_LEVELS if p <= x}


def test_furthest_distance(spark, genome):
    one = K.bin_peaks(peaks(spark, [("1", 100_000, 100_000, "x"), ("1", 300_000, 300_000, "y"), ("1", 900_000, 900_000, "z"), ("2", 300_000, 300_000, "w")]), genome, RES, 2)
    found = lambda window, most: {r.what for r in P.pair_peaks(one, one, 2, window, max_dist=most).collect()}
    assert found("intra", 60) == {"xy", "yx", "yz", "zy"} and found("intra", None) == {"xy", "yx", "yz", "zy", "xz", "zx"}
    assert {"xw", "wx", "zw", "wz"} <= found("all", 20) and "xz" not in found("all", 20)


def test_jobs_from_files_to_files(spark, tmp_path):
    """SAM text to a matrix, matrix and lists to waffles, waffles merged, written as text and predicted from."""
    import random

    from gridpile import jobs

    r = random.Random(3)
    at = lambda name: str(tmp_path / name)
    sizes = {"1": 2_000_000, "2": 900_000}
    lines = [f"@SQ\tSN:{c}\tLN:{n}" for c, n in sizes.items()]
    reads = []
    for i in range(6000):
        c1, c2 = r.choice("12"), r.choice("12")
        p1, p2 = r.randrange(1, sizes[c1]), r.randrange(1, sizes[c2])
        reads.append((c1, p1, c2, p2))
        lines.append(f"r{i}\t65\t{c1}\t{p1}\t60\t10M\t{c2 if c2 != c1 else '='}\t{p2}\t0\tA\tB")
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "bias.tsv").write_text("".join(f"{b}\t{2.0 if b % 2 else 1.0}\n" for b in range(292)))
    header = jobs.count_reads(spark, at("x.sam"), at("matrix"), 10_000, bias=at("bias.tsv"), bad=[5])
    assert header.resolution == 10_000 and header.chroms == list(sizes.items())
    (tmp_path / "a.bed").write_text("".join(f"{c}\t{p}\t{p}\n" for c, p in ((r.choice("12"), r.randrange(0, 800_000)) for _ in range(60))))
    (tmp_path / "b.bed").write_text("".join(f"{c}\t{p}\t{p}\n" for c, p in ((r.choice("12"), r.randrange(0, 800_000)) for _ in range(60))))
    for k, window in enumerate(("0-300000", "300000-2000000")):
        jobs.peak_waffles(spark, at("matrix"), at("a.bed"), at("b.bed"), at(f"w{k}"), 2, window)
    jobs.peak_waffles(spark, at("matrix"), at("a.bed"), at("b.bed"), at("all"), 2, "intra")
    assert jobs.merge_waffles(spark, [at("w0"), at("w1"), at("gone")], at("sum")) == [at("gone")]
    key = lambda p: sorted((x.grp, x.x, x.y, round(x.sum_nrm, 9), x.passage) for x in spark.read.parquet(at(f"{p}/cells")).collect())
    assert key("sum") == key("all") and len(key("all")) > 20
    # the same sums from the reads
    start = {"1": 0, "2": 201}
    count = {}
    for c1, p1, c2, p2 in reads:
        a, b = sorted((start[c1] + (p1 - 1) // 10_000, start[c2] + (p2 - 1) // 10_000))
        count[a, b] = count.get((a, b), 0) + 1
    bins = lambda f: {(c, int(p) // 10_000) for c, p, _ in (x.split() for x in (tmp_path / f).read_text().splitlines()) if 2 <= int(p) // 10_000 <= sizes[c] // 10_000 - 2}
    pairs = {tuple(sorted((start[c] + p, start[d] + q))) for c, p in bins("a.bed") for d, q in bins("b.bed") if c == d and abs(p - q) >= 5}
    total = sum(count.get((g + i, h + j), 0) / (2.0 if (g + i) % 2 else 1.0) / (2.0 if (h + j) % 2 else 1.0) for g, h in pairs for i in range(-2, 3) for j in range(-2, 3) if 5 not in (g + i, h + j))
    assert abs(sum(x[3] for x in key("all")) - total) < 1e-6
    jobs.predict_waffles(spark, at("sum"), at("prediction"))
    assert len(spark.read.text(at("prediction")).collect()) == 1
    assert jobs.waffle_figures(spark, at("sum"))["mean"].count() == 25
    with pytest.raises(KeyError):
        jobs.waffle_figures(spark, at("sum"), "nobody")


def test_a_run_written_twice_counts_once(spark, scene, tmp_path):
    """A retried run of the split sink takes its own place, a failed attempt never counts, other runs add up."""
    cells = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 1.5, 2.25, 1), ("", 1, 0, 0.0, 0.0, 2.0, 4.0, 2)], waffles.CELLS)
    head = spark.createDataFrame([("a", 10, 5, 7), ("", 10, 5, 1)], waffles.HEAD)
    path = str(tmp_path / "s")
    for run in ("one", "two", "one"):
        assert waffles.write_split(cells, head, path, run) == run
    cells.write.partitionBy("grp").parquet(f"{path}/cells/run=three/attempt=lost")
    c, h = waffles.read_split(spark, path)
    assert {(r.grp, r.x, r.sum_nrm, r.passage) for r in c.collect()} == {("a", 0, 3.0, 2), ("", 1, 4.0, 4)}
    assert {(r.grp, r.counter) for r in h.collect()} == {("a", 14), ("", 2)}


def test_many_files_are_merged_in_few_jobs(spark, tmp_path):
    """As many jobs for 60 waffles as for 3; paths that are not there, hold other files, torn ones or other tables are told."""
    cells = spark.createDataFrame([("", 0, 0, 0.0, 0.0, 1.0, 1.0, 1)], waffles.CELLS).coalesce(1)
    head = spark.createDataFrame([("", 10, 5, 2)], waffles.HEAD).coalesce(1)
    waffles.write_waffle(cells, head, str(tmp_path / "w0"))
    import shutil

    for k in range(1, 60):
        shutil.copytree(tmp_path / "w0", tmp_path / f"w{k}")
    paths = [str(tmp_path / f"w{k}") for k in range(60)]
    torn, other, text = (str(tmp_path / x) for x in ("torn", "other", "text"))
    shutil.copytree(tmp_path / "w0", torn)
    file = next((tmp_path / "torn" / "cells").glob("*.parquet"))
    file.write_bytes(file.read_bytes()[:-9])
    spark.range(3).toDF("something").write.parquet(f"{other}/head")
    shutil.copytree(tmp_path / "w0" / "cells", f"{other}/cells")
    for part in ("cells", "head"):
        spark.range(3).select(F.col("id").cast("string")).write.text(f"{text}/{part}")
    wrong = [torn, other, text, str(tmp_path / "nowhere")]

    def jobs_of(group, p):
        spark.sparkContext.setJobGroup(group, group)
        try:
            c, h, missed = waffles.merge_files(spark, p)
            assert c.first().passage == len(p) - len(missed) and h.first().counter == 2 * (len(p) - len(missed))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return missed, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, some = jobs_of("few", paths[:3])
    many, as_many = jobs_of("many", paths + wrong)
    # listing more than 32 folders is a job of its own for each of the four reads
    assert (few, many) == ([], wrong) and as_many <= some + 4
    with pytest.raises(FileNotFoundError):
        waffles.merge_files(spark, wrong + paths)


def test_bins_of_very_many_contigs(spark):
    """100,000 contigs are searched by blocks: no nested loop, whatever the plan."""
    contigs = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("c"), "id").alias("chrom"), (F.col("id") % 5 + 1).alias("n"))
    from pyspark.sql import Window

    table = contigs.withColumn("bin_end", F.sum("n").over(Window.orderBy("ord"))).withColumn("bin_start", F.col("bin_end") - F.col("n")).cache()
    got = G.locate(spark.createDataFrame([(0,), (1,), (14,), (299_999,), (300_000,), (-1,)], "b bigint"), table, "b")
    assert {(r.b, r.chrom, r.local_bin) for r in got.collect()} == {(0, "c0", 0), (1, "c1", 0), (14, "c4", 4), (299_999, "c99999", 4)}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    table.unpersist()


def test_fasta_in_tiny_splits(spark, tmp_path):
    """Records go on over splits: the bases before a split's first header belong to the last header before."""
    r = random.Random(8)
    sizes_of = {f"c{k}": r.randrange(0, 4_000) for k in range(12)}
    text = "".join(f">{c} some words\n" + "".join("ACGTN"[i % 5] + ("\n" if i % 61 == 60 else "") for i in range(n)) + "\n" for c, n in sizes_of.items())
    (tmp_path / "g.fa").write_text(text)
    for split in (97, 1_000, None):
        got = sizes.fasta_sizes(spark, str(tmp_path / "g.fa"), split).orderBy("ord").collect()
        assert [(x.chrom, x.size_bp) for x in got] == list(sizes_of.items())


@pytest.mark.parametrize("span", [0, 2, 31, 40, 100])
def test_windows_that_are_bad_throughout(spark, span):
    """Bad runs of all lengths at all places against the plain definition; no window without a partition."""
    r = random.Random(span)
    bad, at = set(), 0
    while at < 3_000:
        at += r.randrange(1, 40)
        n = r.choice([1, 3, 64, 65, 2 * span, 2 * span + 1, 2 * span + 2, 300])
        bad |= set(range(at, at + n))
        at += n
    peaks_at = list(range(span, 3_200))
    df = spark.createDataFrame([("1", g, g, "") for g in peaks_at], "chrom string, bin bigint, gbin bigint, feature string")
    got = K.drop_all_bad(df, span, spark.createDataFrame([(b,) for b in bad], "bin bigint"))
    assert sorted(x.gbin for x in got.collect()) == [g for g in peaks_at if not all(b in bad for b in range(g - span, g + span + 1))]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_draws_without_replacement():
    """All orders of k of m things are as likely, and depend on seed, cell and draw alone."""
    import numpy as np
    from collections import Counter

    got = stats.drawn_orders(1, 3, np.arange(24_000), 4, 3)
    seen = Counter(map(tuple, got))
    assert len(seen) == 24 and all(850 < n < 1150 for n in seen.values())
    assert (stats.drawn_orders(1, 3, np.arange(500, 600), 4, 3) == got[500:600]).all()
    assert (np.sort(stats.drawn_orders(2, 0, np.arange(50), 24, 24), axis=1) == np.arange(24)).all()


def test_local_moran_is_dealt_out(spark):
    """At span 20 many tasks draw, and blocks of cells do not change results."""
    board = mean_cells(spark, [[2.0 ** ((r * 7 + c * c) % 5) for c in range(9)] for r in range(9)])
    one = {(x.cell, x.p_sim) for x in stats.moran_local(board, permutations=99).collect()}
    old, stats.MORAN_BLOCK = stats.MORAN_BLOCK, 50
    try:
        assert {(x.cell, x.p_sim) for x in stats.moran_local(board, permutations=99).collect()} == one and len(one) == 81
    finally:
        stats.MORAN_BLOCK = old
    assert 41 * 41 / old > 200
