import hashlib
import random

import numpy as np
import pyarrow as pa

from gridpile.llm import fingerprint as fp


def words(r, n):
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_edges(spark):
    """Ids with gaps, ties, repeats and nulls; null, empty, long and multi-byte texts; clashing columns."""
    r = random.Random(4)
    rows = [(3, "abé\U0001f600d"), (1, None), (9, words(r, 3000)), (9, words(r, 20)), (12, ""), (40, "x"), (40, "x"), (None, "first one here"), (700, words(r, 500))]
    rows += [(1000 + 7 * i, words(r, r.randrange(0, 200))) for i in range(60)]
    df = spark.createDataFrame([(a, b, "z", 1, 2) for a, b in rows], "doc_id long, text string, fingerprint string, _range int, _ghost int")
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    for each in (3, 1000):
        got = fp.fingerprint_edits(df, rows_each=each).collect()
        key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if r.doc_id == 40:
                assert r.near_edited == 1
    assert len({r.fingerprint for r in got if r.doc_id == 40}) == 1


def test_one_and_none(spark):
    one = fp.fingerprint_edits(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].next_doc_id == 5 and one[0].near_next == 1
    assert fp.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_containment_of_unequal_texts():
    """A passage in a book a hundred times as long; the estimates of many lie near the truth; sketches merge."""
    r = random.Random(5)
    book = words(r, 60_000)
    tokens = book.split()
    errors = []
    for k in range(40):
        at = r.randrange(50_000)
        part = " ".join(tokens[at : at + 600] + words(r, 200).split())
        h, o, e = fp.sketch_batch(pa.array([part, book]))
        a, b = h[: o[1]], h[o[1] :]
        truth = len(shingles(part) & shingles(book)) / len(shingles(part))
        small, inside, _ = fp.likeness(a, e[0], b, e[1])
        assert small == inside
        errors.append(inside - truth)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2
    x, y = words(r, 900), words(r, 700)
    h, o, e = fp.sketch_batch(pa.array([x, y, x + "\n" + y]))
    s = [fp.to_string(h[o[i] : o[i + 1]], e[i]) for i in range(3)]
    merged, united = fp.from_string(fp.merge(s[0], s[1]))[0], fp.from_string(s[2])[0]
    assert set(merged.tolist()) <= set(united.tolist()) and len(united) - len(merged) <= 4 and fp.from_string(fp.merge(*s[:2]))[1] is None


def hashes(t):
    """The retained set, from its definition."""
    h, o = fp.shingle_hashes(*fp.word_hashes(pa.array([t]), True), 5)
    return {x >> 16 for x in h.tolist() if x < 1 << 62}


def test_equal_texts_are_alike_and_others_as_their_sets(spark):
    """Brute force over the definition: one fraction for all sizes; repetitive and short texts equal to the next give 1."""
    r = random.Random(6)
    texts = []
    for _ in range(60):
        t = r.choice([words(r, r.randrange(0, 12)), words(r, r.randrange(200, 900)), "a b c d e f " * r.randrange(1, 200)])
        texts += [t] * r.choice([1, 2])
    got = sorted(fp.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    for r_, t, n in zip(got, texts, texts[1:] + texts[:1]):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        for other, near in ((e, r_.near_edited), (n, r_.near_next)):
            a, b = hashes(t), hashes(other)
            want = 1.0 if t.split() == other.split() else len(a & b) / min(len(a), len(b)) if a and b else 0.0
            assert abs(near - want) < 1e-12
        assert set(fp.from_string(r_.fingerprint)[0].tolist()) == hashes(t)


def test_sketch_edges():
    h, o, d = fp.sketch_batch(pa.array(["a b c d e f g", "A  b c d e\tf g", None, "", "b a"]))
    assert d[0] == d[1] and d[2] == d[3] and d[4] not in d[:4]
    assert fp.likeness(h[:0], d[2], h[:0], d[3])[0] == 1 and fp.likeness(h[:0], d[2], h[:1], d[4])[0] == 0
    assert abs(len(fp.sketch_batch(pa.array([words(random.Random(1), 20_000)]))[0]) / 20_000 - 1 / fp.SCALE) < 0.02


def test_plain_fingerprints(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "A  b\n")], "id long, text string")
    got = {r.id: r.fingerprint for r in fp.fingerprints(df).collect()}
    assert got[1] == got[3] and got[2].endswith(":") and got[2] != got[1]


def test_an_id_that_many_rows_share_is_split(spark):
    """A third of all rows have no id, a third one id, some repeat a row: ranges stay small, and each row follows by (id, text)."""
    r = random.Random(7)
    rows = [(None, words(r, r.randrange(1, 6))) for _ in range(600)] + [(50, r.choice(["é", "z", "\U0001f600", "w"]) + words(r, r.randrange(1, 6))) for _ in range(600)]
    rows += [(i, words(r, 3)) for i in range(600)] + [(50, "same row")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ranged, split = fp._range_of(df, 10)
    assert split and ranged.groupBy("_range").count().agg({"count": "max"}).first()[0] <= 80
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for i, (d, t) in enumerate(order):
        n = order[(i + 1) % len(order)]
        want.append((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[1][: len(t) // 2]).encode()).hexdigest(), n[0]))
    key = lambda x: tuple((y is not None, y or 0) if not isinstance(y, str) else y for y in x)
    got = [(x.doc_id, x.n_chars, x.edited_sha256, x.next_doc_id) for x in fp.fingerprint_edits(df, rows_each=10).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
