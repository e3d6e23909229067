"""Tiles of the matrix, stored and not, and streams of reads."""

import random

from pyspark.sql import functions as F

from gridpile.operators import contacts as C
from gridpile.operators import tiles as T
from gridpile.operators import waffle as W
from gridpile.streaming import increments

PAIRS = "g1 bigint, g2 bigint, what string, what_new string"


def made(seed, pairs, bins, contacts, labels=("", "x")):
    r = random.Random(seed)
    ps = {(min(a, b), max(a, b), r.choice(labels)) for a, b in ((r.randrange(50, bins - 50), r.randrange(50, bins - 50)) for _ in range(pairs))}
    cs = {}
    for _ in range(contacts):
        a, b = r.randrange(bins), r.randrange(bins)
        cs[min(a, b), max(a, b)] = (r.randrange(1, 9), r.randrange(1, 64) / 16)
    return ps, cs


def brute(ps, cs, span):
    out = {}
    for g1, g2, what in ps:
        for i in range(-span, span + 1):
            for j in range(-span, span + 1):
                if v := cs.get((g1 + i, g2 + j)):
                    s = out.setdefault((what, i + span, j + span), [0, 0, 0, 0, 0])
                    for k, x in enumerate((v[0], v[0] ** 2, v[1], v[1] ** 2, 1)):
                        s[k] += x
    return {k: tuple(v) for k, v in out.items()}


def frames(spark, ps, cs):
    p = spark.createDataFrame([(a, b, w, f"{a}-{b}") for a, b, w in ps], PAIRS)
    return p, spark.createDataFrame([(a, b, x, y) for (a, b), (x, y) in cs.items()], "bin1 bigint, bin2 bigint, raw bigint, nrm double")


def sums(df):
    return {(r.grp, r.x, r.y): (r.sum_raw, r.sqr_raw, r.sum_nrm, r.sqr_nrm, r.passage) for r in df.collect()}


def test_kernel_equals_brute_force_at_all_spans(spark, monkeypatch):
    for span in (0, 2, 9, 20):
        ps, cs = made(span, 300, 400, 6_000)
        p, c = frames(spark, ps, cs)
        assert sums(W.waffle(p, c, span, with_raw=True)) == brute(ps, cs, span)
    assert sums(W.waffle(p, c, 2, both_are_feature=True, with_raw=True)) == brute({(a, b, "") for a, b, _ in ps}, cs, 2) or len({(a, b) for a, b, _ in ps}) < len(ps)


def test_all_pairs_in_one_tile(spark):
    """A tile that all pairs fall into: lists of bounded size, and a row for each match alone."""
    ps = {(a, b, "") for a in range(325, 375) for b in range(325, 375) if a <= b}
    cs = {(a, b): (1, 0.5) for a in range(300, 400) for b in range(a, 400) if (a * b) % 5 == 0}
    p, c = frames(spark, ps, cs)
    side = T.tile_side(2)
    lists, tiles = T.listed(p, 2, side, labels=True), T.tiled(c, side)
    matches = T.matched(lists, tiles, side, 2)
    n = sum(int(v[4]) for v in brute(ps, cs, 2).values())
    assert matches.count() == n
    got = {(r.what_new, r.bin1, r.bin2, r.x, r.y, r.raw, r.nrm) for r in matches.collect()}
    assert len(got) == n and all(cs[b1, b2] == (raw, nrm) for _, b1, b2, _, _, raw, nrm in got)
    sizes = [len(r.pairs) for r in lists.collect()]
    assert max(sizes) <= (side + 4) ** 2
    # the join meets each list with one tile: no more rows than lists
    assert lists.join(tiles, "tile").count() <= len(sizes)
    assert sums(W.waffle(p, c, 2, with_raw=True)) == brute(ps, cs, 2)


def test_stored_tiles_move_no_contact(spark, tmp_path):
    ps, cs = made(3, 400, 900, 20_000)
    p, c = frames(spark, ps, cs)
    path = f"file://{tmp_path}/matrix"
    T.write_tiles(c, path, buckets=4)
    tiles, side = T.open_tiles(spark, path)
    assert side == T.SIDE
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = T.stored_waffle(p, tiles, side, 2)
        assert sums(got) == brute(ps, cs, 2)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    plan = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "tile#" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    above, low = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < low:
            low = depth(x)
            above.append(x)
            if "Join" in x:
                break
    assert above and "Join" in above[-1] and not any("Exchange" in x for x in above)
    assert "PushedFilters" not in lines[scan] or "tile" in lines[scan]


def test_stored_tiles_without_pairs(spark, tmp_path):
    _, c = frames(spark, *made(5, 1, 200, 50))
    path = f"file://{tmp_path}/m2"
    T.write_tiles(c, path, side=16, buckets=2)
    assert T.stored_waffle(spark.createDataFrame([], PAIRS), *T.open_tiles(spark, path), 2).count() == 0


def test_stream_of_reads_that_meet_again(spark, tmp_path):
    """Batches whose bins come again give the sums of one run over all reads; reads that come too late are dropped."""
    ps, _ = made(6, 250, 300, 0)
    r = random.Random(7)
    reads = [(r.randrange(40, 260), r.randrange(40, 260)) for _ in range(150)]
    reads = [r.choice(reads) for _ in range(900)]
    batches = [reads[:300], reads[300:500], reads[500:]]
    for k, b in enumerate(batches):
        rows = [(x, y, f"2020-01-0{k + 1} 00:00:00") for x, y in b] + ([(100, 100, "2019-01-01 00:00:00")] if k == 2 else [])
        df = spark.createDataFrame(rows, "a bigint, b bigint, time string").withColumn("time", F.to_timestamp("time"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    bad = spark.createDataFrame([(b,) for b in range(7, 300, 37)], "bin bigint")
    bias = spark.range(300).select(F.col("id").alias("bin"), F.expr("cast(pow(2, id % 3) as double)").alias("b"))
    factors = lambda c: C.normalise(C.drop_bad(c, bad), bias)
    p, _ = frames(spark, ps, {})
    want = W.waffle(p, factors(C.count_contacts(spark.createDataFrame(reads, "a bigint, b bigint"))), 3, with_raw=True)
    stream = lambda: spark.readStream.schema("a bigint, b bigint, time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = increments.stream_reads(stream(), p, factors, 3, str(tmp_path / "out"), str(tmp_path / "ck"), delay="1 hour")
    assert q.awaitTermination(240) and q.exception() is None
    assert sums(increments.read_increments(spark, str(tmp_path / "out"))) == sums(want) and len(sums(want)) > 20
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 3


def test_lists_are_bounded_however_many_labels(spark):
    """Every pair of a tile has a label of its own: lists grow in number, not in length."""
    n = 200_000
    pairs = spark.range(n).selectExpr("id % 60 + 2 AS g1", "(id div 60) % 60 + 2 AS g2", "concat('a', id) AS what")
    sizes = [r.n for r in T.listed(pairs, 2, 64).select(F.size("pairs").alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) < 1.5 * T.LIST < n / T.SPLITS
    assert T.listed(pairs.where("g1 < 4"), 2, 64).count() == T.SPLITS
