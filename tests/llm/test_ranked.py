import math
import re
from collections import Counter

from gridpile.llm import ranked
from gridpile.llm.queries import ORACLE, QUERIES
from tests.conftest import same_rows

DOCS = "doc_id bigint, text string, rank int, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    for item, ts in wanted.items():
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    got = ranked.search(spark.createDataFrame([(i, t, 7, "x") for i, t in docs], DOCS), spark.createDataFrame(items, "item_id bigint, text string"), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_equals_sql(spark, small, duck):
    same_rows(QUERIES["op11_window_search"](spark, small), duck, ORACLE["op11_window_search"])


def test_odd_rows(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "..."), (4, "alpha beta"), (4, "alpha gamma ALPHA"), (None, "alpha beta"), (None, "naïve Straße 東京"), (5, "alpha beta"), (6, "Beta," * 3000), (7, "x" * 70_000 + " alpha"), (8, "İI 12a")]
    items = [(1, "ALPHA beta"), (1, "gamma"), (2, None), (3, "?!"), (4, "naïve straße 東京 ı"), (5, "x" * 70_000), (None, "beta"), (6, "nowhere"), (7, "i̇i İi 12A")]
    monkeypatch.setattr(ranked, "_SLICE", 4096)
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert [r for r in want if r[0] == 5] and [r for r in want if r[0] is None]
    # several passes give the same
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 2)
    assert found(spark, docs, items) == want


def test_ties_and_hot_rows_over_windows(spark, monkeypatch):
    """A third of the rows has no id, equal texts tie, and a window holds few rows."""
    docs = [(None if k % 3 == 0 else k, "red " * (k % 4) + "blue " * (k % 7)) for k in range(700)]
    items = [(k, t) for k, t in enumerate(("red", "blue red", "blue", "green"))]
    assert found(spark, docs, items, top=25) == brute(docs, items, 25)


def test_many_windows_of_one_task():
    q = ranked._Query.arrays([["a", "b"], ["b"]])
    import numpy as np

    scorer = ranked._Scorer(q, np.array([5, 9]), 10, 100, 3)
    for start in range(0, 4 * 100, 100):
        tf = np.tile([1, 2], 50)
        scorer.window(list(range(start, start + 50)), np.full(50, 10), np.arange(0, 101, 2), np.tile(np.array([0, 1], np.int32), 50), tf)
    # all documents are alike, so the first ones stay
    assert [sorted(e[2] for e in heap) for heap in scorer.heaps] == [[0, 1, 2], [0, 1, 2]]
    assert not scorer.bits.any() and not scorer.sums.any()


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a b")], []) == []
