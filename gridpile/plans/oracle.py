"""The queries in SQL, written from their definitions, for comparison."""

from __future__ import annotations

from .queries import RANGE

LOW, HIGH = (int(x) // 10_000 for x in RANGE.split("-"))

GENOME = """
chroms AS (SELECT CAST(r_regionkey AS INT) AS ord, r_name AS chrom, CAST(1000000 + 250000 * r_regionkey AS BIGINT) AS size_bp FROM region),
nb AS (SELECT *, CAST(floor(size_bp / 10000.0) AS BIGINT) + 1 AS n_bins FROM chroms),
sec AS (SELECT ord, chrom, size_bp, n_bins,
  CAST(SUM(n_bins) OVER (ORDER BY ord) - n_bins AS BIGINT) AS bin_start, CAST(SUM(n_bins) OVER (ORDER BY ord) AS BIGINT) AS bin_end FROM nb)"""
PEAKS = GENOME + """,
rawp AS (
  SELECT 'A' AS side, r_name AS chrom, (s_suppkey * 7919 * 131) % (1000000 + 250000 * r_regionkey) AS pos, CAST(s_nationkey % 3 AS VARCHAR) AS feature
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'B', r_name, (c_custkey * 104729) % (1000000 + 250000 * r_regionkey), c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
okf AS (
  SELECT DISTINCT side, rawp.chrom, CAST(floor(pos / 10000.0) AS BIGINT) AS bin, bin_start + CAST(floor(pos / 10000.0) AS BIGINT) AS gbin, feature
  FROM rawp JOIN sec ON rawp.chrom = sec.chrom WHERE floor(pos / 10000.0) BETWEEN 2 AND n_bins - 3),
ok AS (SELECT DISTINCT side, chrom, bin, gbin FROM okf)"""
MATRIX = """,
m AS (
  SELECT least(a, b) AS bin1, greatest(a, b) AS bin2, CAST(count(*) AS BIGINT) AS raw
  FROM (SELECT (l_orderkey * 31 + l_linenumber * 17) % 755 AS a, (l_partkey * 13 + l_suppkey * 7) % 755 AS b FROM lineitem) t GROUP BY 1, 2),
bias AS (SELECT CAST(range AS BIGINT) AS bin, CASE range % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1e0 WHEN 2 THEN 2e0 ELSE 4e0 END AS b FROM range(755)),
mat AS (
  SELECT bin1, bin2, raw, raw / x.b / y.b AS nrm FROM m JOIN bias x ON x.bin = bin1 JOIN bias y ON y.bin = bin2
  WHERE bin1 % 37 <> 0 AND bin2 % 37 <> 0)"""
_NEAR = "a.chrom = b.chrom AND abs(a.bin - b.bin) >= 5"
_ON = {
    "intra": _NEAR,
    "inter": "a.chrom <> b.chrom",
    "all": f"(({_NEAR}) OR a.chrom <> b.chrom)",
    "range": f"{_NEAR} AND abs(a.bin - b.bin) > {LOW} AND abs(a.bin - b.bin) <= {HIGH}",
}


def _pairs(window: str, name: str = "pairs") -> str:
    on = _ON.get(window, window)
    return f""",
{name} AS (SELECT DISTINCT least(a.gbin, b.gbin) AS g1, greatest(a.gbin, b.gbin) AS g2 FROM ok a JOIN ok b ON a.side = 'A' AND b.side = 'B' AND {on})"""


FEATURE_PAIRS = f""",
pairs AS (SELECT DISTINCT least(a.gbin, b.gbin) AS g1, greatest(a.gbin, b.gbin) AS g2, a.feature || b.feature AS what,
  CASE WHEN a.gbin > b.gbin THEN b.chrom || ':' || b.bin || '-' || a.chrom || ':' || a.bin ELSE a.chrom || ':' || a.bin || '-' || b.chrom || ':' || b.bin END AS what_new
  FROM okf a JOIN okf b ON a.side = 'A' AND b.side = 'B' AND {_NEAR})"""


def _cells(extra: str = "", pairs: str = "pairs", name: str = "hit") -> str:
    return f""",
{name} AS (SELECT {extra} bin1, bin2, raw, nrm, CAST(i.range AS INT) AS x, CAST(j.range AS INT) AS y
  FROM {pairs} CROSS JOIN range(5) i CROSS JOIN range(5) j JOIN mat ON bin1 = g1 - 2 + i.range AND bin2 = g2 - 2 + j.range)"""


_SUMS = "CAST(sum(nrm) AS DOUBLE) AS sum_nrm, CAST(sum(nrm * nrm) AS DOUBLE) AS sqr_nrm, CAST(count(*) AS BIGINT) AS passage"
_COUNT = "CAST((SELECT count(*) FROM pairs) AS BIGINT) AS counter"
_GRID = ",\ngrid AS (SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y FROM range(5) a, range(5) b)"
DENSE = "WITH " + PEAKS + MATRIX + _pairs("intra") + _cells() + _GRID + """,
w AS (SELECT x, y, sum(nrm) AS s FROM hit GROUP BY x, y),
d AS (SELECT grid.x, grid.y, coalesce(s, 0) / (SELECT count(*) FROM pairs) AS mean, grid.y AS r, 4 - grid.x AS c FROM grid LEFT JOIN w USING (x, y))"""
_DOMAIN = ",\ngroups AS (SELECT feature AS grp FROM okf UNION SELECT what FROM pairs),\nheads AS (SELECT grp, CAST((SELECT count(*) FROM pairs WHERE what = grp) AS BIGINT) AS counter FROM groups)"
_FDENSE = "WITH " + PEAKS + MATRIX + FEATURE_PAIRS + _cells("what,") + _GRID + _DOMAIN + """,
w AS (SELECT what AS grp, x, y, sum(nrm) AS sum_nrm, sum(nrm * nrm) AS sqr_nrm, count(*) AS passage FROM hit GROUP BY 1, 2, 3),
d AS (SELECT heads.grp, grid.x, grid.y, coalesce(sum_nrm, 0) AS sum_nrm, coalesce(sqr_nrm, 0) AS sqr_nrm, coalesce(passage, 0) AS passage, counter
  FROM heads CROSS JOIN grid LEFT JOIN w ON w.grp = heads.grp AND w.x = grid.x AND w.y = grid.y)"""
_DX = "sqrt(5e0) - sqrt(CAST(abs(2 - r) + abs(2 - c) AS DOUBLE))"
_NORMAL = DENSE + f",\nxy AS (SELECT r, c, {_DX} AS dx, (mean - avg(mean) OVER ()) / stddev_pop(mean) OVER () AS dy FROM d)"
_LOOP = DENSE + f",\nxy AS (SELECT r, c, {_DX} AS dx, (mean - avg(mean) OVER (PARTITION BY r <= 2 AND c <= 2)) / stddev_pop(mean) OVER (PARTITION BY r <= 2 AND c <= 2) AS dy FROM d)"
_FIT = _NORMAL + """,
mo AS (SELECT avg(dx) AS mx, avg(dy) AS my, var_pop(dx) AS sxx, var_pop(dy) AS syy, covar_pop(dx, dy) AS sxy, count(*) AS n FROM xy),
sl AS (SELECT *, (syy - (sxx / syy) ** 2 * sxx + sqrt((syy - (sxx / syy) ** 2 * sxx) ** 2 + 4 * (sxx / syy) ** 2 * sxy ** 2)) / (2 * sxy) AS slope FROM mo)"""
_NBR = DENSE + """,
off AS (SELECT CAST(a.range AS INT) - 2 AS di, CAST(b.range AS INT) - 2 AS dj FROM range(5) a, range(5) b WHERE NOT (a.range = 2 AND b.range = 2)),
nbr AS (SELECT y + x * 5 AS cell, y + di + (x + dj) * 5 AS ncell, greatest(abs(di), abs(dj)) AS dist, mean / greatest(abs(di), abs(dj)) AS w
  FROM d, off WHERE y + di BETWEEN 0 AND 4 AND x + dj BETWEEN 0 AND 4)"""
_MORAN = _NBR + """,
z AS (SELECT y + x * 5 AS cell, CASE WHEN min(mean) OVER () > 0 THEN log2(nullif(mean, 0)) - avg(log2(nullif(mean, 0))) OVER () END AS z FROM d),
rw AS (SELECT cell, ncell, w / sum(w) OVER (PARTITION BY cell) AS w FROM nbr),
lag AS (SELECT rw.cell, sum(w * z) AS lag FROM rw JOIN z ON z.cell = ncell GROUP BY 1)"""
#: Numbers are mixed as splitmix64 does, in whole numbers of 128 bits.
_WORD = "CAST(18446744073709551615 AS UHUGEINT)"


#: Neighbourhoods drawn at random, 9,999 of each cell: a random number of 1 to j for each of the last numbers j, put in front, or j behind it.
_DRAWN = _MORAN + f""",
vals AS (SELECT list(z ORDER BY cell) AS v, avg(z * z) AS spread FROM z HAVING count(z) = count(*)),
near AS (SELECT cell, list(ncell ORDER BY ncell) AS nb, list(w ORDER BY ncell) AS ws, count(*) AS k FROM rw GROUP BY cell),
numbers AS (SELECT cell, draw.range AS draw, s.range AS s, 24 - k + 1 + s.range AS j, (CAST({1 << 46} + (CAST(cell AS BIGINT) << 26) + draw.range * 64 + s.range AS UHUGEINT) * CAST({0x9E3779B97F4A7C15} AS UHUGEINT)) & {_WORD} AS h0 FROM near, range(9999) draw, range(24) s WHERE s.range < k),
once AS (SELECT *, (CAST(xor(h0, h0 >> 30) AS UHUGEINT) * CAST({0xBF58476D1CE4E5B9} AS UHUGEINT)) & {_WORD} AS h1 FROM numbers),
again AS (SELECT *, (CAST(xor(h1, h1 >> 27) AS UHUGEINT) * CAST({0x94D049BB133111EB} AS UHUGEINT)) & {_WORD} AS h2 FROM once),
steps AS (SELECT cell, draw, list([CAST(CAST(xor(h2, h2 >> 31) AS UBIGINT) % CAST(j AS UBIGINT) AS BIGINT) + 1, CAST(j AS BIGINT)] ORDER BY s) AS steps FROM again GROUP BY cell, draw),
orders AS (SELECT cell, draw, list_reduce(list_prepend(CAST([] AS BIGINT[]), steps), lambda got, x: CASE WHEN list_contains(got, x[1])
  THEN list_concat(list_slice(got, 1, list_position(got, x[1])), [x[2]], list_slice(got, list_position(got, x[1]) + 1, len(got))) ELSE list_prepend(x[1], got) END) AS o FROM steps),
sims AS (SELECT orders.cell, v[orders.cell + 1] * list_sum(list_transform(range(1, k + 1), lambda i: ws[i] * v[o[i] + CASE WHEN o[i] > orders.cell THEN 1 ELSE 0 END])) AS sim, spread,
  v[orders.cell + 1] * list_sum(list_transform(range(1, k + 1), lambda i: ws[i] * v[nb[i] + 1])) AS seen FROM orders JOIN near USING (cell), vals),
ps AS (SELECT cell, CAST(count(*) FILTER (sim >= seen - 1e-9 * spread) AS BIGINT) AS larger FROM sims WHERE spread > 0 GROUP BY cell),
loc AS (SELECT cell, round(z * lag / sum(z * z) OVER () * (count(*) OVER () - 1), 6) AS local,
  CAST(CASE WHEN z IS NULL THEN NULL WHEN z > 0 AND lag > 0 THEN 1 WHEN lag > 0 THEN 2 WHEN z > 0 THEN 4 ELSE 3 END AS INT) AS quadrant FROM z JOIN lag USING (cell)),
tested AS (SELECT loc.*, round((least(larger, 9999 - larger) + 1) / 10000e0, 9) AS p_sim FROM loc LEFT JOIN ps USING (cell))"""
_MORAN_LOOP = _MORAN.replace("mean / greatest(abs(di), abs(dj)) AS w", "(2 - greatest(abs(di), abs(dj))) * mean AS w")


def _two_sided(rho: str, n: int) -> str:
    """Two-sided p of a rank correlation among n values (n odd): Student's t with n - 2 degrees of freedom as the finite sum in the
    angle whose sine is the correlation."""
    terms, factor = [], 1.0
    for k in range(1, (n - 2) // 2 + 1):
        terms.append(f"{factor!r} * pow(1 - {rho} * {rho}, {2 * k - 1} / 2e0)")
        factor *= 2 * k / (2 * k + 1)
    return f"(1 - 2 / pi() * (asin(abs({rho})) + abs({rho}) * ({' + '.join(terms)})))"


def _prediction(over: str) -> str:
    """over: the cells that share a z-score."""
    return f"""{_FDENSE},
      o AS (SELECT grp, y AS r, 4 - x AS c, sum_nrm / counter AS mean FROM d WHERE counter > 0),
      xy AS (SELECT grp, {_DX} AS dx, (mean - avg(mean) OVER (PARTITION BY {over})) / nullif(stddev_pop(mean) OVER (PARTITION BY {over}), 0) AS dy FROM o),
      ra AS (SELECT grp, dy, rank() OVER (PARTITION BY grp ORDER BY dx) + (count(*) OVER (PARTITION BY grp, dx) - 1) / 2e0 AS a, rank() OVER (PARTITION BY grp ORDER BY dy) + (count(*) OVER (PARTITION BY grp, dy) - 1) / 2e0 AS b FROM xy),
      corr AS (SELECT grp, CASE WHEN count(dy) = count(*) THEN corr(a, b) END AS rho FROM ra GROUP BY grp),
      rho AS (SELECT grp, CASE WHEN isnan(rho) THEN NULL ELSE rho END AS rho FROM corr),
      pv AS (SELECT grp, rho, {_two_sided('rho', 25)} AS pval FROM rho),
      mid AS (SELECT grp, sum(mean) / 9 AS center FROM o WHERE r BETWEEN 2 AND 4 AND c BETWEEN 2 AND 4 GROUP BY grp)
      SELECT h.grp, round(rho, 7) AS spear, round(pval, 7) AS pval, round(coalesce(center, 0e0), 9) AS center, coalesce(pval < 0.05 AND rho > 0 AND center > 1, false) AS test
      FROM heads h LEFT JOIN pv ON pv.grp = h.grp LEFT JOIN mid ON mid.grp = h.grp"""


#: From the table of Student's t: 0.975 at 25 - 2 - 1 degrees of freedom.
_T22 = "2.073873067904"

SQL: dict[str, str] = {
    "genome_sections": f"WITH {GENOME} SELECT * FROM sec",
    "bin_lookup": f"WITH {GENOME} SELECT CAST(range AS BIGINT) AS bin, chrom, CAST(range - bin_start AS BIGINT) AS local_bin FROM range(755) JOIN sec ON range >= bin_start AND range < bin_end",
    "peaks_binned": f"WITH {PEAKS} SELECT chrom, bin, gbin, feature, side FROM okf",
    "peaks_raw_count": f"WITH {PEAKS} SELECT side, CAST(count(*) AS BIGINT) AS n FROM rawp GROUP BY side",
    "windows_masked": f"WITH {PEAKS} SELECT DISTINCT gbin, CAST(o.range AS INT) AS off, CAST(gbin - 2 + o.range AS BIGINT) AS p FROM ok, range(5) o WHERE (gbin - 2 + o.range) % 37 <> 0",
    "peaks_usable": f"""WITH {PEAKS} SELECT DISTINCT chrom, bin, gbin FROM ok
      WHERE EXISTS (SELECT 1 FROM range(5) o WHERE (gbin - 2 + o.range) % 37 <> 0 AND NOT (gbin - 2 + o.range BETWEEN 100 AND 110))""",
    "contacts_count": f"WITH {PEAKS}{MATRIX} SELECT * FROM m",
    "contacts_read_filter": """SELECT least(a, b) AS bin1, greatest(a, b) AS bin2, CAST(count(*) AS BIGINT) AS raw
      FROM (SELECT (l_orderkey * 31 + l_linenumber * 17) % 755 AS a, (l_partkey * 13 + l_suppkey * 7) % 755 AS b FROM lineitem WHERE l_linenumber & 5 = 0) t GROUP BY 1, 2""",
    "contacts_normalised": f"""WITH {PEAKS}{MATRIX}
      SELECT bin1, bin2, raw, CASE WHEN x.chrom = y.chrom AND bin2 - bin1 < 50 THEN nrm / (1e0 / (2 ** ((bin2 - bin1) % 3))) ELSE nrm END AS nrm
      FROM mat JOIN sec x ON bin1 >= x.bin_start AND bin1 < x.bin_end JOIN sec y ON bin2 >= y.bin_start AND bin2 < y.bin_end""",
    "contacts_window_all": f"WITH {PEAKS}{MATRIX} SELECT * FROM mat",
    "contacts_window_range": f"WITH {PEAKS}{MATRIX} SELECT * FROM mat WHERE bin2 - bin1 BETWEEN {LOW} AND {HIGH}",
    "pairs_self": f"""WITH {PEAKS} SELECT DISTINCT least(a.gbin, b.gbin) AS g1, greatest(a.gbin, b.gbin) AS g2, a.feature || b.feature AS what
      FROM okf a JOIN okf b ON a.side = 'A' AND b.side = 'A' AND {_NEAR}""",
    "pairs_feature_labels": f"WITH {PEAKS}{FEATURE_PAIRS} SELECT * FROM pairs",
    "pair_counter": f"WITH {PEAKS}{FEATURE_PAIRS}{_DOMAIN} SELECT grp, CAST(10000 AS INT) AS resolution, CAST(5 AS INT) AS size, counter FROM heads",
    "pair_cells": f"""WITH {PEAKS}{_pairs('intra')} SELECT CAST(g1 - 2 + a.range AS BIGINT) AS p1, CAST(g2 - 2 + b.range AS BIGINT) AS p2, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y
      FROM pairs, range(5) a, range(5) b WHERE (g1 - 2 + a.range) % 37 <> 0 AND (g2 - 2 + b.range) % 37 <> 0""",
    "waffle_by_feature": f"WITH {PEAKS}{MATRIX}{FEATURE_PAIRS}{_cells('what,')} SELECT what AS grp, x, y, {_SUMS} FROM hit GROUP BY 1, 2, 3",
    "waffle_first_is_feature": f"""WITH {PEAKS}{MATRIX},
      firsts AS (SELECT DISTINCT rawp.chrom, CAST(floor(pos / 10000.0) AS BIGINT) AS bin, bin_start + CAST(floor(pos / 10000.0) AS BIGINT) AS gbin, rawp.chrom || ':' || pos || '-' || pos AS feature
        FROM rawp JOIN sec ON rawp.chrom = sec.chrom WHERE side = 'A' AND floor(pos / 10000.0) BETWEEN 2 AND n_bins - 3),
      pairs AS (SELECT DISTINCT least(a.gbin, b.gbin) AS g1, greatest(a.gbin, b.gbin) AS g2, a.feature AS what FROM firsts a JOIN ok b ON b.side = 'B' AND {_NEAR})
      {_cells('what,')}, t AS (SELECT what, sum(nrm) AS s, count(*) AS n FROM hit GROUP BY 1)
      SELECT f.grp, CAST((SELECT count(*) FROM pairs WHERE what = f.grp) AS BIGINT) AS counter, CAST(coalesce(s, 0) AS DOUBLE) AS sum_nrm, CAST(coalesce(n, 0) AS BIGINT) AS passage
      FROM (SELECT DISTINCT feature AS grp FROM firsts) f LEFT JOIN t ON what = f.grp""",
    "waffle_both_features": f"WITH {PEAKS}{MATRIX}{FEATURE_PAIRS}{_cells()} SELECT '' AS grp, x, y, {_SUMS} FROM hit GROUP BY x, y",
    "submatrix_keyed": f"""WITH {PEAKS}{MATRIX}, pairs AS (SELECT DISTINCT least(a.gbin, b.gbin) AS g1, greatest(a.gbin, b.gbin) AS g2,
        CASE WHEN a.gbin > b.gbin THEN b.chrom || ':' || b.bin || '-' || a.chrom || ':' || a.bin ELSE a.chrom || ':' || a.bin || '-' || b.chrom || ':' || b.bin END AS what_new
        FROM ok a JOIN ok b ON a.side = 'A' AND b.side = 'B' AND {_ON['range']}){_cells('what_new,')}
      SELECT what_new, CAST(x + y * 5 AS INT) AS cell, nrm FROM hit""",
    "submatrix_cells": f"""WITH {PEAKS}{MATRIX}{_pairs('range')}{_cells()}
      SELECT a.chrom AS chrom1, bin1 - a.bin_start AS local1, b.chrom AS chrom2, bin2 - b.bin_start AS local2, x, y, nrm, '' AS grp
      FROM hit JOIN sec a ON bin1 >= a.bin_start AND bin1 < a.bin_end JOIN sec b ON bin2 >= b.bin_start AND bin2 < b.bin_end""",
    "waffle_raw": f"WITH {PEAKS}{MATRIX}{_pairs('intra')}{_cells()} SELECT x, y, CAST(sum(raw) AS DOUBLE) AS sum_raw, CAST(sum(raw * raw) AS DOUBLE) AS sqr_raw FROM hit GROUP BY x, y",
    "waffle_dense": f"{_FDENSE} SELECT grp, x, y, CAST(sum_nrm AS DOUBLE) AS sum_nrm, CAST(sqr_nrm AS DOUBLE) AS sqr_nrm, CAST(passage AS BIGINT) AS passage, counter FROM d",
    "waffle_mean_pairs": f"{DENSE} SELECT x, y, round(mean, 9) AS mean FROM d",
    "waffle_mean_observed": f"WITH {PEAKS}{MATRIX}{_pairs('intra')}{_cells()} SELECT x, y, round(avg(nrm), 9) AS mean FROM hit GROUP BY x, y",
    "waffle_merge": f"WITH {PEAKS}{MATRIX}{FEATURE_PAIRS}{_cells('what,')} SELECT what AS grp, x, y, {_SUMS}, CAST((SELECT count(*) FROM pairs p WHERE p.what = hit.what) AS BIGINT) AS counter FROM hit GROUP BY 1, 2, 3",
    "waffle_merge_split": f"WITH {PEAKS}{MATRIX}{FEATURE_PAIRS}{_cells('what,')} SELECT what AS grp, x, y, {_SUMS} FROM hit WHERE what = '0BUILDING' GROUP BY 1, 2, 3",
    "waffle_compact": f"""WITH {PEAKS}{MATRIX}{_pairs('intra')}{_cells()}
      SELECT x, y, CAST(count(*) AS BIGINT) AS passage, CAST(round_even(sum(nrm) * 1000, 0) AS BIGINT) AS sum_fixed, CAST(round_even(sum(nrm * nrm) * 1000, 0) AS BIGINT) AS sqr_fixed FROM hit GROUP BY x, y""",
    "center_score": f"{_FDENSE} SELECT grp, round(sum(sum_nrm / counter) / 9, 9) AS center FROM d WHERE counter > 0 AND y BETWEEN 2 AND 4 AND 4 - x BETWEEN 2 AND 4 GROUP BY grp",
    "decay_normal": f"{_NORMAL} SELECT r, c, round(dx, 9) AS dx, round(dy, 7) AS dy FROM xy",
    "decay_loop": f"{_LOOP} SELECT r, c, round(dx, 9) AS dx, round(dy, 7) AS dy FROM xy",
    "spearman_rho": f"""{_LOOP}, ra AS (SELECT rank() OVER (ORDER BY dx) + (count(*) OVER (PARTITION BY dx) - 1) / 2e0 AS a, rank() OVER (ORDER BY dy) + (count(*) OVER (PARTITION BY dy) - 1) / 2e0 AS b FROM xy)
      SELECT round(corr(a, b), 9) AS rho, CAST(count(*) AS BIGINT) AS n FROM ra""",
    "fit_deming": f"{_FIT} SELECT round(slope, 5) AS slope, round(my - slope * mx, 5) AS intercept FROM sl",
    "fit_r2": f"{_FIT} SELECT round(1 - (SELECT sum((dy - (my - slope * mx) - slope * dx) ** 2) FROM xy, sl) / (n * syy), 5) AS r2 FROM sl",
    "fit_bands": f"""{_FIT},
      ends AS (SELECT min(dx) AS x0, max(dx) - min(dx) AS wide FROM xy),
      mse AS (SELECT sum((dy - (my - slope * mx) - slope * dx) ** 2) / (25 - 2 - 1) AS mse FROM xy, sl),
      places AS (SELECT CAST(range AS INT) AS i, x0 - wide * 0.01 + range * (wide * 1.02) / 999 AS x FROM range(1000), ends),
      near AS (SELECT i, x, my - slope * mx + slope * x AS y, 1 / n + (x - mx) ** 2 / (n * sxx) AS near FROM places, sl)
      SELECT '' AS grp, i, round(x, 9) AS x, round(y, 5) AS y, round({_T22} * sqrt(mse * near), 5) AS confidence, round({_T22} * sqrt(mse * (1 + near)), 5) AS prediction FROM near, mse""",
    "predict": _prediction("grp, r <= 2 AND c <= 2"),
    "predict_normal": _prediction("grp"),
    "moran_weights": f"{_NBR} SELECT cell, ncell, dist, round(w, 9) AS w FROM nbr",
    "moran_weights_loop": f"{_NBR} SELECT cell, ncell, dist, round(w * dist * (2 - dist), 9) AS w FROM nbr",
    "moran_quadrants_loop": f"""{_MORAN_LOOP} SELECT cell, round(z * lag / sum(z * z) OVER () * (count(*) OVER () - 1), 6) AS local,
        CAST(CASE WHEN z IS NULL THEN NULL WHEN z > 0 AND lag > 0 THEN 1 WHEN lag > 0 THEN 2 WHEN z > 0 THEN 4 ELSE 3 END AS INT) AS quadrant FROM z JOIN lag USING (cell)""",
    "pairs_max_dist": f"WITH {PEAKS}{_pairs(_NEAR + ' AND abs(a.bin - b.bin) <= 40')} SELECT * FROM pairs",
    "predict_scores": f"""{_FDENSE},
      o AS (SELECT grp, y AS r, 4 - x AS c, sum_nrm / counter AS mean FROM d WHERE counter > 0),
      xy AS (SELECT grp, {_DX} AS dx, (mean - avg(mean) OVER (PARTITION BY grp, r <= 2 AND c <= 2)) / nullif(stddev_pop(mean) OVER (PARTITION BY grp, r <= 2 AND c <= 2), 0) AS dy FROM o),
      ra AS (SELECT grp, dy, rank() OVER (PARTITION BY grp ORDER BY dx) + (count(*) OVER (PARTITION BY grp, dx) - 1) / 2e0 AS a, rank() OVER (PARTITION BY grp ORDER BY dy) + (count(*) OVER (PARTITION BY grp, dy) - 1) / 2e0 AS b FROM xy),
      rho AS (SELECT grp, CASE WHEN count(dy) = count(*) THEN corr(a, b) END AS rho FROM ra GROUP BY grp),
      mid AS (SELECT grp, sum(mean) / 9 AS center FROM o WHERE r BETWEEN 2 AND 4 AND c BETWEEN 2 AND 4 GROUP BY grp)
      SELECT grp, round(CASE WHEN isnan(rho) THEN NULL ELSE rho END, 7) AS spear, round(center, 9) AS center FROM rho JOIN mid USING (grp)""",
    "moran_global": f"""{_MORAN},
      sym AS (SELECT cell, ncell, sum(w) AS w, sum(wt) AS wt FROM (SELECT cell, ncell, w, 0e0 AS wt FROM rw UNION ALL SELECT ncell, cell, 0e0, w FROM rw) u GROUP BY 1, 2),
      per AS (SELECT cell, sum(w) AS r, sum(wt) AS k, sum((w + wt) ** 2) AS twice FROM sym GROUP BY 1),
      t AS (SELECT count(*) AS n, sum(z * lag) AS zl, sum(z * z) AS z2, sum(z ** 4) AS z4, sum(r) AS s0, sum(twice) / 2 AS s1, sum((r + k) ** 2) AS s2 FROM per JOIN z USING (cell) JOIN lag USING (cell)),
      v AS (SELECT n / s0 * zl / z2 AS i, -1e0 / (n - 1) AS expected,
        (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - (z4 / n) / (z2 / n) ** 2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - (1e0 / (n - 1)) ** 2 AS variance FROM t)
      SELECT round(i, 7) AS i, round(expected, 9) AS expected, round(variance, 7) AS variance, round((i - expected) / sqrt(variance), 5) AS z FROM v""",
    "moran_quadrants": f"""{_MORAN} SELECT cell, round(z * lag / sum(z * z) OVER () * (count(*) OVER () - 1), 6) AS local,
        CAST(CASE WHEN z IS NULL THEN NULL WHEN z > 0 AND lag > 0 THEN 1 WHEN lag > 0 THEN 2 WHEN z > 0 THEN 4 ELSE 3 END AS INT) AS quadrant FROM z JOIN lag USING (cell)""",
    "moran_local": f"{_DRAWN} SELECT * FROM tested",
    "moran_hot_spots": f"{_DRAWN} SELECT cell, level, quadrant FROM tested, (SELECT unnest([0.01e0, 0.005e0, 0.001e0, 0.0005e0, 0.0001e0, 0.00005e0, 0.00001e0]) AS level) l WHERE p_sim <= level",
    "polar_rings": f"""{DENSE}, plane AS (SELECT CAST(a.range AS INT) - 2 AS i, CAST(b.range AS INT) - 2 AS j FROM range(9) a, range(9) b),
      rings AS (SELECT i, j, abs(2 - i) + abs(2 - j) AS k FROM plane WHERE abs(2 - i) + abs(2 - j) < 5),
      walk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i, j) - 1 AS t, count(*) OVER (PARTITION BY k) AS n FROM rings)
      SELECT CAST(k AS INT) AS k, CAST(CASE WHEN t % 2 = 0 THEN (n + 1) // 2 - 1 - t // 2 ELSE (n + 1) // 2 + t // 2 END AS INT) AS ordinal, round(mean, 9) AS value
      FROM walk LEFT JOIN d ON d.r = j AND d.c = i""",
}
for _w in ("intra", "inter", "all", "range"):
    SQL[f"pairs_{_w}"] = f"WITH {PEAKS}{_pairs(_w)} SELECT * FROM pairs"
    SQL[f"waffle_{_w}"] = f"WITH {PEAKS}{MATRIX}{_pairs(_w)}{_cells()} SELECT x, y, {_SUMS}, {_COUNT} FROM hit GROUP BY x, y"
for _w, _op in (("intra", "="), ("inter", "<>")):
    SQL[f"contacts_window_{_w}"] = f"""WITH {PEAKS}{MATRIX} SELECT mat.* FROM mat JOIN sec x ON bin1 >= x.bin_start AND bin1 < x.bin_end JOIN sec y ON bin2 >= y.bin_start AND bin2 < y.bin_end WHERE x.chrom {_op} y.chrom"""
#: At 1,000 bases a bin the genome has 7,505 bins.
SQL["waffle_fine"] = SQL["waffle_intra"].replace("/ 10000.0", "/ 1000.0").replace("755", "7505")
_parts = []
for _label, _on in (("intra", _NEAR), *((f"{a}0000-{b}0000" if a else f"0-{b}0000", f"{_NEAR} AND abs(a.bin - b.bin) > {a} AND abs(a.bin - b.bin) <= {b}") for a, b in ((0, 30), (30, 60), (60, 300)))):
    _parts.append((_label, _on))
SQL["waffle_windows_total"] = (
    f"WITH {PEAKS}{MATRIX}" + "".join(_pairs(on, f"p{i}") + _cells(pairs=f"p{i}", name=f"h{i}") for i, (_, on) in enumerate(_parts))
    + " " + " UNION ALL ".join(f'SELECT \'{label}\' AS "window", CAST(coalesce(sum(nrm), 0) AS DOUBLE) AS total, CAST(count(*) AS BIGINT) AS passage FROM h{i}' for i, (label, _) in enumerate(_parts)))
SQL["waffle_stored"] = SQL["waffle_intra"]
