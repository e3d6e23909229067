import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpile.llm import common

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\r\x0b\x0cabéZ\U0001f600", max_size=30)), max_size=8)


def split(t):
    return re.findall(common.WORD, t or "")


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_and_shingles(rows):
    """Equal words hash alike, others not; counts and places are those of the pattern; shingles follow."""
    h, o = common.word_hashes(pa.array(rows, pa.string()))
    words = [split(t) for t in rows]
    assert np.diff(o).tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    seen = {}
    for w, x in zip(flat, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    s, so = common.shingle_hashes(h, o, 3)
    want = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] * bool(w) for w in words]
    assert np.diff(so).tolist() == [len(x) for x in want]
    names = {}
    for k, x in zip([k for r in want for k in r], s.tolist()):
        assert names.setdefault(k, x) == x
    assert len(set(names.values())) == len(names)


def test_slices_do_not_matter(monkeypatch):
    r = random.Random(1)
    rows = [" ".join("x" * r.randrange(1, 9) + str(r.randrange(50)) for _ in range(r.randrange(0, 60))) for _ in range(40)] + ["y" * 300, None, ""]
    whole = common.word_hashes(pa.array(rows), True, True)
    monkeypatch.setattr(common, "_SLICE", 64)
    cut = common.word_hashes(pa.array(rows), True, True)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    part = common.word_hashes(pa.array(rows).slice(5, 20), True, True)
    assert (part[0] == whole[0][whole[1][5] : whole[1][25]]).all()
