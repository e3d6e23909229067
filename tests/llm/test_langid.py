import random

from gridpile.llm import langid

WORDS = {"en": "the of and with thing reason other water", "de": "der die und nicht schule wasser gegen", "fr": "le les dans avec chose autre eau raison"}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) + r.choice(["", "", r.choice(WORDS[lang].split())]) for _ in range(n))


def labelled(spark, seed, n):
    r = random.Random(seed)
    rows = [(i, text(r, lang := r.choice(list(WORDS)), r.randrange(1, 60)), lang, f"s{r.randrange(4)}", 0, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, guess string"), rows


def test_held_out_accuracy(spark):
    df, _ = labelled(spark, 1, 400)
    model = langid.fit(df)
    assert model[0] == ["de", "en", "fr", "und"]
    new, rows = labelled(spark, 2, 300)
    got = {r.doc_id: r for r in langid.identify(langid.document_evidence(new), model).collect()}
    assert sum(got[i].lang == lang for i, _, lang, *_ in rows) >= 294
    assert sum(got[i].kept for i, *_ in rows) >= 297


def test_scores_by_brute_force(spark):
    """The text likelihoods of whole texts, however they are cut, and those of null, empty and letterless ones."""
    import math

    import numpy as np
    import pyarrow as pa

    df, rows = labelled(spark, 3, 100)
    langs, table = langid.fit(df)
    texts = [rows[0][1], None, "", "12 34 !!", "x" * 5000 + " Wasser", "éè ü"]
    got = [np.zeros((len(texts), len(langs))), np.zeros(len(texts), int)]
    for row, cell, n in langid._trigrams(pa.array(texts)):
        np.add.at(got[0], row, table[:, cell].T)
        np.add.at(got[1], row, 1)
    for i, t in enumerate(texts):
        b = langid._FOLD[np.frombuffer((t or "").encode(), np.uint8)].astype(np.uint32)
        want, seen = np.zeros(len(langs)), 0
        for k in range(len(b) - 2):
            x, y, z = (int(v) for v in b[k : k + 3])
            if (x == y == 32) or (y == z == 32):
                continue
            cell = (((x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 19
            want += table[:, cell]
            seen += 1
        assert np.allclose(want, got[0][i]) and seen == got[1][i]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.text_likelihoods(out, (langs, table)).collect()}
    assert all(np.allclose(rows[i].ll, got[0][i]) for i in range(len(texts)))
    assert math.isclose(table[-1].sum(), -langid.CELLS * math.log(langid.CELLS))


def page(lang, body, host, path="/x"):
    return f"http://{host}{path}", f'<!DOCTYPE html><html lang="{lang}"><head><script>the the the</script></head><body>{body}</body></html>' if lang else f"<p>{body}</p>"


def test_evidence_of_pages(spark):
    """A short text leans on its declaration and host; strong text beats both; nulls and empty pages have defined results."""
    r = random.Random(5)
    df, _ = labelled(spark, 6, 300)
    model = langid.fit(df)
    pages = [(i, *page("de", text(r, "de", 30), "a.wasser.de")) for i in range(60)] + [(100 + i, *page("fr", text(r, "fr", 30), "b.eau.fr", "/fr/1")) for i in range(60)]
    pages += [(200, *page("de", "wa", "a.wasser.de")), (201, *page("fr", "wa", "b.eau.fr", "/fr/2")), (202, *page("de", text(r, "en", 80), "a.wasser.de")), (203, None, None), (204, "http://a.wasser.de/", ""), (None, *page("fr", text(r, "fr", 20), "c.eau.fr"))]
    p = spark.createDataFrame([(a, b, c, "x") for a, b, c in pages], "page_id long, url string, html string, lang string")
    e = {x.page_id: x for x in langid.page_evidence(p).collect()}
    assert (e[100].declared, e[100].suffix, e[100].host, e[100].domain) == ("fr", "fr/fr", "b.eau.fr", "eau.fr") and "the" not in e[100].text.split()
    assert e[203].declared is None and e[203].host is None and e[203].text == ""
    got = {x.page_id: x for x in langid.identify(langid.page_evidence(p), model).collect()}
    assert len(got) == len(pages)
    assert got[200].lang == "de" and got[201].lang == "fr" and got[202].lang == "en" and got[None].lang == "fr"
    assert not got[203].kept and got[203].lang == "und" and not got[204].kept
    assert sum(got[i].lang == "de" for i in range(60)) == 60


def test_junk_is_rejected_and_prose_kept(spark):
    df, rows = labelled(spark, 7, 300)
    model = langid.fit(df)
    r = random.Random(8)
    junk = [(1000 + i, "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(400)), None, None, 0, "") for i in range(20)]
    all_rows = spark.createDataFrame([*rows, *junk, (2000, None, None, None, 0, ""), (2000, None, None, None, 0, "")], df.schema)
    got = langid.identify(langid.document_evidence(all_rows), model).collect()
    assert len(got) == 322 and not any(x.kept for x in got if x.doc_id >= 1000) and sum(x.kept for x in got if x.doc_id < 300) >= 297
    assert langid.identify(langid.document_evidence(all_rows.limit(0)), model).count() == 0
    empty = langid.fit(df.limit(0))
    assert empty[0] == ["und"] and {x.lang for x in langid.identify(langid.document_evidence(df), empty).collect()} == {"und"}
