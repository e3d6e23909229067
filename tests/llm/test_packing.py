import itertools
import random
import re

import numpy as np

from gridpile.llm import packing

SCHEMA = "doc_id long, text string, bucket int, batch string, shard long, n_tokens string"


def waste(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_are_optimal():
    r = random.Random(1)
    for _ in range(25):
        lengths = sorted(r.sample(range(0, 60), r.randrange(1, 9)))
        counts = [r.randrange(1, 9) for _ in lengths]
        for k in (1, 2, 3, 5):
            got = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
            assert len(got) <= k and got[-1] == lengths[-1]
            best = min(waste(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], min(m, len(lengths) - 1)))
            assert waste(lengths, counts, got) == best


def test_pack(spark):
    """Every row has a slot of its own; batches keep the budget; only a bucket's last is short; shards do not show."""
    r = random.Random(2)
    rows = [(i % 500, " ".join("w" for _ in range(int(r.expovariate(1 / 60))))) for i in range(1500)] + [(None, None), (7, ""), (7, " ".join("w" for _ in range(3000)))]
    df = spark.createDataFrame([(a, b, 1, "", 2, "") for a, b in rows], SCHEMA)
    got = packing.pack(df, buckets=4, budget=1000, shard_rows=50).collect()
    assert len(got) == len(rows)
    assert sorted(x.n_tokens for x in got) == sorted(len(re.findall(r"\S+", t or "")) for _, t in rows)
    bounds = sorted({x.padded_len for x in got})
    assert len(bounds) <= 4
    batches = {}
    for x in got:
        assert x.n_tokens <= x.padded_len and x.padding == x.padded_len - x.n_tokens and all(b >= x.padded_len or b < x.n_tokens for b in bounds)
        batches.setdefault((x.bucket, x.batch), []).append(x)
    for (b, n), xs in batches.items():
        assert sorted(x.slot for x in xs) == list(range(len(xs))) and {x.batch_rows for x in xs} == {len(xs)}
        assert len(xs) == 1 or len(xs) * xs[0].padded_len <= 1000
        full = max(1, 1000 // max(1, xs[0].padded_len))
        assert len(xs) == full or (b, n + 1) not in batches
    assert packing.pack(df.limit(0)).count() == 0


def test_long_lengths_are_exact():
    """Many lengths beyond any round number: bounds are lengths that occur, and as good as those of the plain table."""
    r = random.Random(3)
    lengths = np.array(sorted(r.sample(range(0, 200_000), 700)))
    counts = np.array([r.randrange(1, 50) for _ in lengths])
    texts, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = [0] + [float("inf")] * 700
    for _ in range(6):
        best = [0] + [min(best[i] + lengths[j - 1] * (texts[j] - texts[i]) - (tokens[j] - tokens[i]) for i in range(j)) for j in range(1, 701)]
    got = packing.optimal_bounds(lengths, counts, 6)
    assert set(got) <= set(lengths.tolist()) and got[-1] == lengths[-1] and waste(lengths.tolist(), counts.tolist(), got) == best[-1]


def test_rows_of_one_id_are_spread(spark):
    """20,000 equal rows of a null id each have a slot, and fill no shard of their own."""
    df = spark.createDataFrame([(None, "a b c")] * 20_000 + [(1, "a b c")] * 5, "doc_id long, text string")
    got = packing.pack(df, buckets=3, budget=300, shard_rows=100)
    assert got.select("batch", "slot").distinct().count() == 20_005
    rows = packing.number_repeats(df.selectExpr("doc_id", "3L AS n_tokens"), ["doc_id", "n_tokens"]).collect()
    assert sorted(r._nth for r in rows if r.doc_id is None) == list(range(1, 20_001)) and sorted(r._nth for r in rows if r.doc_id) == [1, 2, 3, 4, 5]
