import numpy as np
import pytest

from gridpile.llm import crosspoly
from tests.conftest import same_rows

SCHEMA = "vec_id long, embedding array<float>, label int, node long, c long"


def brute(rows, cosine=0.9):
    ids = [r[0] for r in rows]
    unit = []
    for _, v in rows:
        ok = v and None not in v and np.isfinite(np.asarray(v, np.float64)).all() and np.any(np.asarray(v, np.float64))
        a = np.asarray(v, np.float32).astype(np.float64) if ok else None
        unit.append(a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()) if ok else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(ids[j] for j in seen)
        out[ids[i]] = (len(link[i]), low, low == ids[i])
    return out


def vectors(seed, groups, each, alone, d=64, spread=0.2):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = r.normal(size=d)
        out += [c * s + r.normal(size=d) * spread * np.linalg.norm(c) / np.sqrt(d) for s in r.uniform(0.1, 9, each)]
    out += list(r.normal(size=(alone, d)))
    order = r.permutation(len(out))
    return [(int(i), out[k].astype(np.float32).tolist()) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [4, 32, 2048])
def test_equals_brute_force(spark, block, monkeypatch):
    """Near groups, copies, scaled copies, opposite, null, zero, empty, odd and short vectors; blocks do not show."""
    monkeypatch.setattr(crosspoly, "BLOCK", block)
    rows = vectors(1, 12, 15, 150)
    rows += [(len(rows) + i, v) for i, v in vectors(4, 1, 120, 0)]
    n = len(rows)
    v = rows[0][1]
    rows += [(n, v), (n + 1, v), (n + 2, [2 * x for x in v]), (n + 3, [-x for x in v]), (n + 4, None), (n + 5, [0.0] * 64), (n + 6, []), (n + 7, [float("nan")] + v[1:]), (n + 8, [float("inf")] + v[1:]), (n + 9, [None] + v[1:]), (n + 10, v[:10]), (n + 11, v[:10]), (n + 12, [1e30 * x for x in v]), (n + 13, [-0.0, 1.0, 0.0]), (n + 14, [0.0, 1.0, -0.0])]
    df = spark.createDataFrame([(a, b, 0, 1, 2) for a, b in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in crosspoly.near_vectors(df).collect()}
    assert got == brute(rows)
    assert crosspoly.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_limit():
    """Pairs at cosine 0.9 exactly, with the key length of a large table."""
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    a, b = crosspoly.keys(x, 3), crosspoly.keys(y, 3)
    hit = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert hit.mean() > 0.98


def test_rotation_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(crosspoly.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(crosspoly.hadamard(crosspoly.hadamard(x)), x)


def test_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v), (1, v), (2, v), (None, v), (None, w), (3, w)]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in crosspoly.near_vectors(spark.createDataFrame([(a, b, 0, 1, 2) for a, b in rows], SCHEMA)).collect())
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_equals_sql(spark, small, duck):
    from gridpile.llm import queries

    same_rows(queries.QUERIES["op10_cross_polytope"](spark, small), duck, queries.ORACLE["op10_cross_polytope"])


@pytest.mark.parametrize("parts", [3, 5])
def test_recall_does_not_fall_with_key_length(parts):
    """Pairs at cosine 0.9 exactly, with the tables that the key length asks for."""
    r = np.random.default_rng(parts)
    x = r.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=(1000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    tables = crosspoly.tables_for(parts, 64)
    a, b = (crosspoly.keys(v, parts, tables).reshape(1000, -1) for v in (x, 0.9 * x + np.sqrt(1 - 0.81) * z))
    met = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)])
    assert met > 0.99
