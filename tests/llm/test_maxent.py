import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from gridpile.llm import maxent

SCHEMA = "doc_id long, text string, row long, c long, base double"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def texts(seed, n):
    """Two made-up languages with their own words and word pairs."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        tongue = r.choice("ab")
        w = [f"{tongue}{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(0, 80))]
        out.append((i, " ".join(x for y in w for x in ([y, f"{y}x"] if r.random() < 0.3 else [y]))))
    return out


def test_base_and_held_out_score(spark):
    rows = texts(1, 400) + [(400, None), (400, None), (None, "A1 a1 unseen"), (401, "Éa éa  A2 b"), (402, " ".join(f"u{i}" for i in range(5000)))]
    df = spark.createDataFrame([(a, b, 1, 2, 3.0) for a, b in rows], SCHEMA)
    got = maxent.score_documents(df).collect()
    assert len(got) == len(rows)
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["<end>"]
    c = Counter(w for d, t in rows if not out(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[d, out(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.95
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_sum_to_one(spark):
    """Over classes for any history, and over a class's words and unknown ones."""
    df = spark.createDataFrame([(a, b) for a, b in texts(2, 200)], "doc_id long, text string").withColumn("held_out", maxent.held_out())
    counts = maxent.count_words(df).cache()
    v = maxent.build_vocabulary(df, counts)
    w = maxent.train(df, v)
    t, o = maxent.tokens(pa.array(["a1 a1x b3 zzz", ""]))
    z = maxent.logits(w, maxent.features(t, o, v.classes(t)))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(p.sum(1), 1) and (p > 0).all()
    every = {r.id: r.c for r in counts.collect()}
    ids = np.array(list(every), np.int64).view(np.uint64)
    cls = v.classes(ids)
    assert abs(sum(10 ** v.head_log[np.searchsorted(v.head, i)] for i, c in zip(ids, cls) if c == cls[0]) - 1) < 1e-6
    logs = v.word_logs(w)
    assert np.abs(w[maxent.CELLS :]).max() > 0.01  # learned
    for c in np.unique(v.top_class):
        assert np.allclose(np.exp(logs[:, v.top_class == c]).sum(1), 1)
    # unseen words and the known ones beside them fill the classes of rare words
    rare = np.flatnonzero(~np.isin(ids, v.top))
    for c in np.unique(v.cell_class):
        known = sum(10 ** (v.known_log[int(ids[i]) & 0xFF] + math.log10(every[int(ids[i : i + 1].view(np.int64)[0])])) for i in rare if cls[i] == c)
        unseen = v.unseen[c] * 10 ** v.unknown_log[np.flatnonzero(v.cell_class == c)[0]]
        assert known == 0 or abs(known + unseen - 1) < 1e-6
    assert (v.unknown_log < 0).all() and v.n == sum(every.values()) and v.v == len(every)


def prose(seed, n, first):
    """Words of a Zipf-like vocabulary, each of which has a few words that mostly follow it."""
    r, order = random.Random(seed), random.Random(77)
    names = ["".join(order.choice("abcdefghij") for _ in range(order.randrange(2, 9))) for _ in range(3000)]
    after = [[int(3000 * order.random() ** 3) for _ in range(4)] for _ in range(3000)]
    out = []
    for i in range(n):
        w, at = [], 0
        for _ in range(150):
            at = r.choice(after[at]) if r.random() < 0.6 else int(3000 * r.random() ** 3)
            w.append(names[at])
        out.append((first + i, " ".join(w)))
    return out


def test_noise_scores_below_prose_and_known_tokens_gain(spark):
    """Held-out prose beats the base on known tokens alone; random strings score below it, token by token."""
    r = random.Random(4)
    held = [i for i in range(100_000, 103_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = prose(1, 1500, 0)
    clean = [(held[i], t) for i, (_, t) in enumerate(prose(2, 60, 0))]
    noise = [(held[100 + i], " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(200))) for i in range(20)]
    got = {x.doc_id: x for x in maxent.score_documents(spark.createDataFrame(train + clean + noise, "doc_id long, text string")).collect()}
    each = lambda rows, c: sum(got[d][c] for d, _ in rows) / sum(got[d].n_tokens for d, _ in rows)
    assert all(got[d].n_known == got[d].n_tokens for d, _ in clean)
    assert each(clean, "score") > each(clean, "base_score") + 0.1
    assert each(noise, "score") < each(clean, "score") - 1


def test_updates_of_many_tasks_add_up(spark, monkeypatch):
    """Deep trees of small groups give the weights that one group gives; LEVELS too few leave rows that the driver adds."""
    df = spark.createDataFrame([(a, b) for a, b in texts(3, 150)], "doc_id long, text string").withColumn("held_out", maxent.held_out()).repartition(20, "doc_id")
    v = maxent.build_vocabulary(df, maxent.count_words(df))
    one = maxent.train(df, v, rounds=1)
    monkeypatch.setattr(maxent, "FAN", 2)
    many = maxent.train(df, v, rounds=1)
    assert np.abs(one[1:]).max() > 0.01 and np.allclose(one, many, atol=1e-5)


def test_score_by_brute_force(spark, monkeypatch):
    """Every score again by loops over tokens, from the learned weights and classes alone: top, common, rare and unseen words, repeated, null and empty texts."""
    seen = {}
    build, fit = maxent.build_vocabulary, maxent.train
    monkeypatch.setattr(maxent, "build_vocabulary", lambda *a: seen.setdefault("v", build(*a)))
    monkeypatch.setattr(maxent, "train", lambda *a: seen.setdefault("w", fit(*a)))
    r = random.Random(9)
    rows = prose(5, 150, 0) + [(1000 + i, " ".join(f"w{i}x{j} " * (1 + (r.random() < 0.1)) for j in range(110))) for i in range(750)]
    rows += [(5000, None), (5001, ""), (3, "Abc ABC"), (None, rows[0][1]), rows[0], (6000, rows[1][1] + " " + rows[160][1])]
    got = maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    v, w = seen["v"], seen["w"].astype(np.float64)

    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    words = sorted({x for _, t in rows for x in split(t)})
    ids, offsets = maxent.tokens(pa.array([*words, ""]))
    number = {x: int(ids[offsets[i]]) for i, x in enumerate([*words, None])}
    texts_of = [(d, [number[x] for x in [*split(t), None]]) for d, t in rows]
    c = Counter(x for d, t in texts_of if not out(d) for x in t)
    assert len(c) > 65_536 and len(c) < len(number)  # words beyond those that tasks have, and unseen ones

    end = number[None]
    ranked = sorted((x for x in c if x != end), key=lambda x: (-c[x], x - (1 << 64) * (x >= 1 << 63)))
    place = {int(x): i for i, x in enumerate(v.top)}
    assert set(place) == {end, *ranked[:8191]}
    kind = lambda x: int(v.top_class[place[x]]) if x in place else int(v.cell_class[x & 255])
    rare, once, top_of = Counter(), Counter(), Counter()
    for x, n in c.items():
        if x in place:
            top_of[kind(x)] += n
        else:
            rare[kind(x)] += n
            once[kind(x)] += n == 1
    ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
    unseen = max(ones * ones / (2 * max(twos, 1)), len(c))
    endings = set(v.cell_class.tolist())
    share = lambda k: max(unseen * (once[k] + 0.5) / sum(once[j] + 0.5 for j in endings), 1.0)
    fresh = lambda k: (once[k] + 0.5) / (rare[k] + 2)
    fellows = {k: [x for x in place if kind(x) == k] for k in top_of}
    cells = 1 + 2 * 8192 + 2 * 33 * 33
    pair = lambda k, x: w[cells + (k * 8192 + place[x]) // 32, (k * 8192 + place[x]) % 32] + math.log(c[x] / top_of[kind(x)])
    totals = {}

    def word(x, before):
        k = kind(x)
        if x in place:
            if (before, k) not in totals:
                totals[before, k] = sum(math.exp(pair(before, y)) for y in fellows[k])
            return (pair(before, x) - math.log(totals[before, k])) / math.log(10)
        return math.log10(c[x] / rare[k] * (1 - fresh(k))) if c[x] else math.log10(fresh(k) / share(k))

    cell = lambda x: int(maxent.mix(np.array([x], np.uint64))[0]) >> 51
    begin = cell(0xBE61_0000_0000_0000)
    want = []
    for d, t in texts_of:
        k, h, score = [32, 32, 32, *map(kind, t)], [begin, begin, begin, *map(cell, t)], 0.0
        for i, x in enumerate(t):
            z = w[0] + w[1 + h[i + 2]] + w[8193 + h[i + 1]] + w[16385 + k[i + 2] * 33 + k[i + 1]] + w[16385 + 33 * 33 + k[i + 2] * 33 + k[i]]
            score += (z[k[i + 3]] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10) + word(x, k[i + 2])
        want.append((d is None, d or 0, len(t), score))
    mine = sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens, x.score) for x in got)
    for a, b in zip(mine, sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4 * a[2], (a, b)


def test_empty(spark):
    assert maxent.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = maxent.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0].held_out and got[0].n_known == 0 and got[0].base_score == 0 and math.isfinite(got[0].score)
