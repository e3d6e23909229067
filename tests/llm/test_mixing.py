import random
import re

import pytest

from gridpile.llm import mixing
from gridpile.llm.common import WORD

SCHEMA = "doc_id long, text string, source string, h int, copies string, n_chars long, lang string"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return done | share
        done |= {s: float(most * sizes[s]) for s in over}


def docs(spark, seed, sources, n):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 30, 200]))) if r.random() > 0.05 else None, r.choices(sources, [5 ** (k % 4) for k in range(len(sources))])[0], 1, "c", 0, "en") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("sources", [["a"], ["b", "a", None, "é", "Z", "\U0001f600"], [f"s{i}" for i in range(25)]])
def test_targets_and_taken(spark, sources):
    df, rows = docs(spark, len(sources), sources, 900)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(WORD, t or "")) for i, t, *_ in rows}
    of, biggest = {}, {}
    for i, _, s, *_ in rows:
        of[s] = of.get(s, 0) + size[i]
        biggest[s] = max(biggest.get(s, 0), size[i])
    want, taken = brute_targets(of), {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == of[r.source] and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in of:
        assert abs(taken[s] - want[s]) <= max(5, 0.5 * biggest[s])
    assert {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()} == {(r.doc_id, r.taken) for r in got}


def test_apply_follows_the_plan(spark):
    df, _ = docs(spark, 9, ["a", "b", None], 300)
    plan = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = mixing.apply_mix(df)
    assert got.columns == df.columns
    seen = {}
    for r in got.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: c for i, c in plan.items() if c}


def test_edges(spark):
    rows = [(None, "a b c", "x", 0, "", 0, ""), (1, "", "y", 0, "", 0, ""), (1, None, "y", 0, "", 0, ""), (2, "d e", None, 0, "", 0, ""), (2, "d e", None, 0, "", 0, "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and all(r.taken <= 3 * r.size for r in got)
    assert {r.taken for r in got if r.source == "y"} == {0}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, 0, "", 0, "")], SCHEMA)).first().taken == 0


@pytest.mark.parametrize("equal", [True, False])
def test_repeated_and_null_ids(spark, equal):
    """10,000 rows of one null id come near their target, equal texts or not; reruns agree as multisets; the mix follows."""
    r = random.Random(3)
    rows = [(None, "w " * (7 if equal else r.randrange(1, 40)), "a", 0, "", 0, "") for _ in range(10_000)] + [(i, "w " * r.choice([3, 400]), "b", 0, "", 0, "") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    for s in "ab":
        own = [x for x in got if x.source == s]
        assert all(x.taken <= 3 * x.size for x in own)
        assert abs(sum(x.taken for x in own) - own[0].target) <= (7 if s == "a" else 200)
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(5)).collect()))
    assert sum(len(x.text.split()) for x in mixing.apply_mix(df).collect()) == sum(x.taken for x in got)


def test_equal_rows_in_two_sources(spark):
    """60 equal rows in each of two sources: the plan and the mixed corpus agree, each source within a row of its target."""
    from pyspark.sql import functions as F

    text = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(5, text, s) for s in ("A", "B") for _ in range(60)], "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("copies").alias("rows")).collect()}
    mixed = {r.source: r["count"] for r in mixing.apply_mix(docs).groupBy("source").count().collect()}
    for s in "AB":
        assert mixed[s] == plan[s].rows and abs(9 * mixed[s] - plan[s].target) <= 9
