import random
import re
import zlib
from collections import Counter

import pytest

from gridpile.llm import variants
from gridpile.llm.queries import ORACLE, QUERIES
from tests.conftest import same_rows


def cuts(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return a in cuts(b) or b in cuts(a)


def brute(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, rows = {}, {}
    for w, c in n.items():
        near = sorted((-m, o) for o, m in n.items() if is_near(w, o))
        form[w] = near[0][1] if near and -near[0][0] >= 2 * c else None
        rows[w] = (c, len(near))
    out = []
    for w, (c, k) in rows.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, c, k, form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def found(df):
    return sorted(map(tuple, variants.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_equals_sql(spark, small, duck):
    same_rows(QUERIES["op12_spelling_variants"](spark, small), duck, ORACLE["op12_spelling_variants"])


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "Straße strasse STRASSE " * 4), (None, "straße " * 9), (3, "straßen " * 30), (3, "straßen " * 30), (4, "aaaaa aaaaaa aaaaaaa " * 5 + "abcd " * 9), (5, "aaaaaa " * 40), (6, "x" * 50_000 + " " + "y" * 5), (7, "don't—naïve naïv×e naïve" * 3), (8, "naive " * 3)]
    got = found(spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id bigint, text string, word string, n int"))
    assert got == brute(docs)
    assert ("straße", 13, 1, "straßen", 60, "straßen") in [(*r[:5], r[5]) for r in got] or any(r[3] for r in got)
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []


@pytest.mark.parametrize("key_words", [2_000, 3])
def test_many_near_words_and_split_keys(spark, monkeypatch, key_words):
    """Words over two letters, so that halves, runs of one letter and near words abound; keys split into many parts give the same."""
    rng = random.Random(5)
    docs = [(k, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(400))) for k in range(40)]
    monkeypatch.setattr(variants, "SHARD_WORDS", 50)
    monkeypatch.setattr(variants.near_words, "__defaults__", (50, key_words))
    assert found(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs)


def test_automaton_numbers_and_minimality():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(600)})
    a = variants.Automaton(words)
    for number, w in enumerate(words):
        state, found = a.follow(a.start, 0, w)
        assert found == number and a.final[state]
    assert a.behind[a.start] == len(words) and a.follow(a.start, 0, "cad") is None
    # no two states accept the same endings
    ends = {}
    for s in range(len(a.edges)):  # children are made before their parents
        ends[s] = (a.final[s], tuple(sorted((c, t) for c, (t, _) in a.edges[s].items())))
    assert len(set(ends.values())) == len(ends)
    # fewer states than letters, as endings are shared
    assert len(a.edges) < sum(map(len, words)) / 3


def test_one_error_after_an_exact_half():
    words = sorted(["hello", "hallo", "hella", "help", "helo", "jello", "hellos"])
    a = variants.Automaton(words)
    near = lambda *x: sorted(words[i] for i in a.near(*x))
    assert near("he", "llo", False) == ["hella"] and near("h", "ello", False) == ["hallo", "hella"]
    assert near("he", "llo", True) == ["helo"] and near("hel", "los", True) == ["hello"]
    assert near("xx", "llo", False) == []
