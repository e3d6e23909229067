import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridpile.llm import repeats
from gridpile.llm.queries import QUERIES

N = repeats.LENGTH


def brute(rows):
    seen = Counter(b[p : p + N] for _, b in rows for p in range(len(b) - N + 1))
    out = []
    for i, b in rows:
        gone = [False] * (len(b) + 1)
        last = 0
        for p in range(len(b) - N + 1):
            if seen[b[p : p + N]] > 1:
                for q in range(max(p, last), p + N):
                    gone[q] = True
                last = p + N
        spans = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def coded(docs):
    return [(i, (t or "").encode()) for i, t in docs]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, b"z", 3) for i, t in docs], "doc_id bigint, text string, digest binary, low int")


def noise(rng, n):
    return "".join(rng.choice("abcdefghij klmnopqrstuvwxyzäß東") for _ in range(n))


def test_all_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op13_suffix_dedup"](spark, small).collect()), key=str)
    assert got == brute(coded(rows))


@pytest.mark.parametrize("run, part, large", [(400_000, 100_000, 20_000), (40, 30, 5)])
def test_shared_passages(spark, monkeypatch, run, part, large):
    """Passages of lengths about the threshold, in other surroundings each time, at ends and beginnings, chained and overlapping; many runs and parts."""
    monkeypatch.setattr(repeats, "RUN", run)
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "LARGE", large)
    monkeypatch.setattr(repeats, "BUCKET", 50)
    rng = random.Random(3)
    passage = noise(rng, 900)
    docs = []
    for k in range(60):
        a = rng.randrange(0, 500)
        docs.append((k, noise(rng, rng.randrange(0, 300)) + passage[a : a + rng.choice([60, 150, 185, 199, 200, 201, 400])] + noise(rng, rng.randrange(0, 300))))
    docs += [(100, passage), (101, passage), (102, passage[100:] + passage[:100]), (103, noise(rng, 90) + passage[:350] + passage[300:700])]
    line = noise(rng, 70) + "\n"
    docs += [(200, line * 9), (201, "a" * 1500), (202, "ab" * 300), (203, line * 4 + "!"), (204, "x" + "a" * 199), (205, "a" * 200)]
    assert found(frame(spark, docs)) == brute(coded(docs))


def test_odd_rows(spark):
    rng = random.Random(4)
    long = noise(rng, 3000)
    docs = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, long), (None, long[:1000] + "!" + long[1000:]), (7, "\0" * 250), (8, "\0" * 199), (9, long[:199]), (9, "y" * 200), (10, "y" * 199 + "z")]
    assert found(frame(spark, docs)) == brute(coded(docs))
    assert found(frame(spark, [])) == []


def test_hot_passage(spark, monkeypatch):
    """A passage that a third of the rows share, and a text that another third repeats."""
    monkeypatch.setattr(repeats, "RUN", 300)
    monkeypatch.setattr(repeats, "PART", 200)
    rng = random.Random(5)
    passage, copy = noise(rng, 350), noise(rng, 260)
    docs = [(k, (noise(rng, 120) + passage + noise(rng, 120), copy, noise(rng, 400))[k % 3]) for k in range(240)]
    assert found(frame(spark, docs)) == brute(coded(docs))


def test_very_long_text_in_steps(monkeypatch):
    """Steps of a long text give the strings that one step gives."""
    rng = random.Random(6)
    text = pa.array([noise(rng, 5000), None, noise(rng, 300), "tiny"])

    def covered():
        raw, offsets = repeats._utf8(text)
        got = [(int(r), p) for _, row, low, high in repeats._sampled(raw, offsets) for r, a, b in zip(row, low, high, strict=True) for p in range(a, b + 1)]
        assert len(set(got)) == len(got)
        return sorted(got)

    whole = covered()
    sizes = [len((t or "").encode()) for t in text.to_pylist()]
    assert whole == [(r, p) for r, n in enumerate(sizes) for p in range(n - N + 1)]
    monkeypatch.setattr(repeats, "_STEP", 700)
    assert covered() == whole


def runs_of(keys, parts):
    out = []
    for part in parts:
        own = np.frombuffer(b"".join(part), np.uint8).reshape(-1, repeats.KEY)
        n = len(own)
        rows = list(repeats._front_coded(own, np.zeros((n, repeats.DIGEST), np.uint8), np.zeros(n, int), np.zeros(n, int), []))
        assert len(rows) == 1 and sum(np.frombuffer(rows[0][4], np.int32)) == n
        out.append((rows[0][2], rows[0][3]))
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 7, 16])
def test_merge_by_common_prefixes(width):
    rng = random.Random(width)
    keys = [bytes(rng.choice(b"ab") for _ in range(30)) + bytes(rng.choice(b"abc") for _ in range(repeats.KEY - 30)) for _ in range(300)]
    keys += [k[:20] + bytes(20) for k in keys[:40]] + keys[:60]
    parts = [rng.choices(keys, k=rng.randint(1, 200)) for _ in range(width)]
    order, shared, heads = repeats.merged(runs_of(keys, parts))
    queues = [iter(sorted(set(p))) for p in parts]
    out = [next(queues[r]) for r in order]
    assert out == sorted(k for p in parts for k in set(p))
    for i in range(1, len(out)):
        same = next((j for j in range(repeats.KEY) if out[i][j] != out[i - 1][j]), repeats.KEY)
        assert shared[i] == same
    assert heads == sorted({k[: repeats.GRAM] for k in out})


def test_known_prefixes_are_not_compared_again(monkeypatch):
    """The merge looks at fewer bytes than comparing whole keys would: at most each key's own, and one for each match."""
    rng = random.Random(9)
    stem = bytes(rng.choice(b"abcd") for _ in range(repeats.GRAM))
    parts = [[stem + bytes(rng.choice(b"abcd") for _ in range(repeats.KEY - repeats.GRAM)) for _ in range(200)] for _ in range(8)]
    looked = []

    class Counting(bytes):
        def __getitem__(self, i):
            if isinstance(i, int):
                looked.append(i)
                return bytes.__getitem__(self, i)
            return Counting(bytes.__getitem__(self, i))

        def __add__(self, other):
            return Counting(bytes.__add__(self, other))

    runs = [(lcps, Counting(rests)) for lcps, rests in runs_of(None, parts)]
    order, *_ = repeats.merged(runs)
    assert len(order) == 1600
    # all keys share their first GRAM bytes: after the first matches nobody looks at them
    assert sum(i < repeats.GRAM for i in looked) <= 2 * repeats.GRAM * len(parts)
