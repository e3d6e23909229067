import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpile.llm import omh
from gridpile.llm.common import word_hashes
from gridpile.llm.components import components

SCHEMA = "doc_id long, text string, digest string, words string, key string, lang string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=24), st.lists(st.integers(0, 4), max_size=24), st.integers(0, 24))
def test_whole_band_distance(a, b, most):
    d = distance(a, b)
    got = omh.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most)
    assert got == (d if d <= most else None)


def test_labels_and_order():
    """Repeats differ by their number; sketches change with the order of the words, not with case or spaces."""
    lab = omh.labelled(np.array([5, 7, 5, 5, 5], np.uint64), np.array([0, 4, 5]))
    assert len(set(lab[:4].tolist())) == 4 and lab[4] == lab[0]
    r = random.Random(1)
    for n in (300, 900, 2000):
        w = [f"w{r.randrange(400)}" for _ in range(n)]
        texts = [" ".join(w), "\n".join(w).upper(), " ".join(w[n // 2 :] + w[: n // 2]), "", "one two"]
        row, key = omh.sketch_rows(*word_hashes(pa.array(texts), True))
        sets = [set(key[row == i].tolist()) for i in range(5)]
        assert sets[0] == sets[1] and not sets[3] and sets[4]
        assert 0.2 < len(sets[0] & sets[2]) / len(sets[0]) < 0.8  # almost the same k-mers, half of the pairs in another order
        parts = [set(omh.sketch_rows(*word_hashes(pa.array(texts), True), first=f, last=t)[1].tolist()) for f, t in ((0, omh.FIRST), (omh.FIRST, None))]
        assert parts[0] | parts[1] == set(key.tolist()) and not parts[0] & parts[1]


def edited(r, w, share):
    out = []
    for x in w:
        if r.random() < share:
            out += r.choice([[], [f"n{r.randrange(9999)}"], [x, f"n{r.randrange(9999)}"]])
        else:
            out.append(x)
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for k in range(25):
        base = [word() for _ in range(r.randrange(60, 400))]
        texts += [base, base] + [edited(r, base, s) for s in (0.02, 0.05, 0.1)]
    texts += [[word() for _ in range(r.randrange(20, 90))] + passage for _ in range(60)]  # share a passage, are not alike
    hot = [word() for _ in range(150)]
    texts += [hot] * 50 + [edited(r, hot, 0.03) for _ in range(60)]
    r.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_classes_equal_brute_force(spark):
    texts = corpus(3)
    df = spark.createDataFrame([(i, t, "", "", "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in omh.near_duplicates(df).collect()}
    words = [t.split() for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        longer = max(len(words[i]), len(words[j]))
        common = len(set(words[i]) & set(words[j]))
        if common > 0.6 * longer - 30 and distance(words[i], words[j]) <= 0.2 * longer:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in range(len(texts))}
    assert {i for i, r in got.items() if r.kept} == {i for i in range(len(texts)) if root(i) == i}


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a"), (5, "A "), (6, "b"), (7, long), (8, long + " end"), (None, long), (None, None), (9, "x y z u v w"), (9, "x y z u v w"), (10, "a b c d e f g h i j k l m n o p"), (10, long)]
    df = spark.createDataFrame([(a, b, "", "", "", "") for a, b in rows], SCHEMA)
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.kept) for r in omh.near_duplicates(df).collect()))
    # 10 has the long text too, so it joins its class; texts 4 and 5 differ in bytes but not in words, yet one k-mer is shared and aligns
    assert got == sorted([(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True), (8, 7, False), (-1, -1, True), (-1, -1, True), (9, 9, True), (9, 9, True), (10, 7, False), (10, 7, False)])
    assert omh.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 200)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)]
    r.shuffle(links)
    got = {x.node: x.component for x in components(spark.createDataFrame(links + links[:20] + [(7, 7)], "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in parent}


def classes_of(spark, texts):
    df = spark.createDataFrame([(i, t, "", "", "", "") for i, t in enumerate(texts)], SCHEMA)
    return [r.class_id for r in sorted(omh.near_duplicates(df).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("chains", [1, 3])
def test_an_edited_copy_of_a_linked_copy(spark, chains):
    """Each B is alike to its A alone, one of many members of a class whose centre it is not alike to."""
    r = random.Random(7)
    new = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    base = new(200)
    texts = [base[:k] + new(2) + base[k + 2 :] for k in range(0, 120, 2)]
    for c in range(chains):
        a = base[:80] + new(28) + base[108:]
        b = a[: 120 + c] + new(14) + a[134 + c :]
        assert distance(a, b) <= 40 < distance(base, b)
        texts += [a, b]
    assert set(classes_of(spark, [" ".join(t) for t in texts])) == {0}


def test_a_chain_of_edits_and_families_with_one_core(spark):
    """60 texts of which only near ones are alike are one class; families that share half their text are classes of their own."""
    r = random.Random(9)
    word = lambda: f"n{r.randrange(10**9)}"
    now = [word() for _ in range(120)]
    texts = []
    for _ in range(60):
        texts.append(now)
        now = [word() if r.random() < 0.07 else w for w in now]
    core = [word() for _ in range(80)]
    families = 40
    for _ in range(families):
        own = [word() for _ in range(80)]
        texts += [core + [word() if r.random() < 0.04 else w for w in own] for _ in range(6)]
    got = classes_of(spark, [" ".join(t) for t in texts])
    assert set(got[:60]) == {0}
    assert got[60:] == [60 + 6 * f for f in range(families) for _ in range(6)]


def test_pairwise_wave_takes_open_buckets_alone(spark, monkeypatch):
    """Of families that share most of a text only those sketches go on to be compared pair by pair whose large buckets hold texts that did not align."""
    r = random.Random(3)
    word = lambda: f"n{r.randrange(10**9)}"
    core = [word() for _ in range(90)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(40)]
        texts += [core + own, core + own[:-1] + [word()]]
    seen, every = [], omh._every
    monkeypatch.setattr(omh, "_every", lambda entries, similarity: seen.append(entries.select("key", "doc_id").collect()) or every(entries, similarity))
    got = classes_of(spark, [" ".join(t) for t in texts])
    assert got == [i - i % 2 for i in range(120)]
    sizes = Counter(x.key for x in seen[0])
    assert sizes and min(sizes.values()) > 1
    assert len(seen[0]) < 120 * 96 / 2  # all of their sketches before
    row, key = omh.sketch_rows(*word_hashes(pa.array([" ".join(t) for t in texts]), True), omh.WORDS)
    own = Counter(key.view(np.int64).tolist())
    assert all(n == own[k] for k, n in sizes.items())  # and whole buckets


def test_mask_of_keys(spark):
    r = np.random.default_rng(2)
    key = r.integers(0, 1 << 64, 3000, np.uint64)
    mask = omh._mask(spark.createDataFrame([(int(k),) for k in key.view(np.int64)], "key long"))
    assert omh._may_hold(mask, key).all()
    assert omh._may_hold(mask, r.integers(0, 1 << 64, 100_000, np.uint64)).mean() < 0.002


@pytest.mark.parametrize("n", [5, 6, 8, 10, 11, 14, 20, 30, 33, 40, 60, 100, 300, 380, 450, 1300, 1700])
def test_recall_at_the_threshold(n):
    """Of pairs of n words with n / 5 edits at random places nine in ten and more share a sketch, by k-mers as by single words."""
    r = random.Random(n)
    texts = []
    trials = 300 if n < 1000 else 80
    for _ in range(trials):
        w = [f"w{r.randrange(3000)}" for _ in range(n)]
        v = list(w)
        for i in r.sample(range(n), n // 5):
            v[i] = f"n{r.randrange(10**6)}"
        texts += [" ".join(w), " ".join(v)]
    words = word_hashes(pa.array(texts), True)
    for levels in (omh.LEVELS, omh.WORDS):
        row, key = omh.sketch_rows(*words, levels)
        sets = [set(key[row == i].tolist()) for i in range(2 * trials)]
        assert sum(bool(sets[2 * i] & sets[2 * i + 1]) for i in range(trials)) >= 0.92 * trials


def test_pairs_across_classes(spark):
    """In small buckets all pairs of different classes, in large ones those with the text that meets most, also where a bucket fills many batches."""
    r = random.Random(4)
    rows = []
    for key in range(60):
        n = r.choice([1, 2, 3, 8, 9, 700 if key % 20 == 0 else 5])
        rows += [(key, 1000 * key + i, r.choice([1, 2, 1000 * key + i]), (r.randrange(9) << omh._MEETS) | 100) for i in range(n)]
    got = {(x.a, x.b, x.large) for x in omh._across(spark.createDataFrame(rows, "key long, doc_id long, comp long, info long").repartition(5), 0.8).collect()}
    expected = set()
    for key in range(60):
        own = sorted(((-i, d, c) for k, d, c, i in rows if k == key))
        if len(own) <= omh.SMALL:
            expected |= {(min(a, b), max(a, b), False) for (_, a, c), (_, b, e) in itertools.combinations(own, 2) if c != e}
        else:
            expected |= {(min(own[0][1], b), max(own[0][1], b), True) for _, b, c in own[1:] if c != own[0][2]}
    assert got == expected
    blank = spark.createDataFrame(rows, "key long, doc_id long, comp long, info long").selectExpr("*", "X'' AS profile")
    every = {(x.a, x.b) for x in omh._every(blank, 0.8).collect()}
    assert every == {(min(a, b), max(a, b)) for key in range(60) for (a, c), (b, e) in itertools.combinations([(d, c) for k, d, c, _ in rows if k == key], 2) if c != e}


def test_profiles_never_part_alike_texts():
    r = random.Random(5)
    texts = [[f"w{r.randrange(40)}" for _ in range(r.randrange(1, 900))] for _ in range(30)]
    words, offsets = word_hashes(pa.array([" ".join(t) for t in texts] + ["a " * 70_000]), True)
    own = omh._profiles(words, offsets)
    most = omh._common_at_most(own, own)
    assert own[-1] == b"" and (most[-1] > 10**9).all()
    for i, j in itertools.product(range(30), repeat=2):
        common = sum((Counter(texts[i]) & Counter(texts[j])).values())
        assert common <= most[i, j] <= common + 200


def test_similarity_below_the_sketches(spark):
    with pytest.raises(ValueError):
        omh.near_duplicates(spark.createDataFrame([], SCHEMA), 0.5)


@pytest.mark.parametrize("n", [32, 35, 40, 45, 60, 100, 300, 330, 450, 1300, 1700])
def test_recall_where_every_fifth_word_is_edited(n):
    """No five words stay together in such a copy, which is as near as the threshold asks for."""
    r = np.random.default_rng(n)
    found, trials = 0, 60 if n > 400 else 200
    for t in range(trials):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        at = np.arange(t % 5, n, 5)[: n // 5]
        b[at] = r.integers(0, 1 << 63, len(at), dtype=np.uint64)
        row, key = omh.sketch_rows(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        found += bool(np.intersect1d(key[row == 0], key[row == 1]).size)
        assert omh.alike(a, b) is not None
    assert found >= 0.92 * trials


def test_regular_edits_are_tied(spark):
    texts, made = [], random.Random(4)
    for n in (35, 60, 100, 300):
        for _ in range(10):
            a = [f"w{made.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(a), " ".join(f"e{made.randrange(10**9)}" if i % 5 == 4 else w for i, w in enumerate(a))]
    got = classes_of(spark, texts)
    assert sum(got[i] == got[i + 1] for i in range(0, len(texts), 2)) >= 36
    assert all(got[i] == i for i in range(0, len(texts), 2))  # and no two of different origin
