import corpus_pipeline
from gridpile.llm import omh, pii, queries


def test_stages(spark, small, tmp_path):
    """Each stage's decisions take effect on all of its input; all but the last return the columns of documents."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        if name != "length_packing":
            assert docs.columns == columns
    before, after = seen["near_dedup"]
    kept = {r.doc_id for r in omh.near_duplicates(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.count() == len(kept) < before.count()
    before, after = seen["remove_pii"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == {i: pii.redact(t) for i, t in texts.items()}
    assert seen["language_id"][1].count() >= 0.99 * seen["language_id"][0].count()
    assert seen["length_packing"][1].count() == seen["source_mix"][1].count()


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the other thing is with the water", "en", None, 3), (2, "the other thing is with the water", "en", None, 3), (3, "x " * 20_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        now = part
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            now.count()


def test_the_registered_query_and_clashing_columns(spark, small, tmp_path):
    """The query's rows are those of its stages by brute-force reading of what each keeps; extra columns of any name pass through."""
    import __spark_entry__ as e
    from pyspark.sql import functions as F

    names = ["_gone", "_GONE_", "_key", "_h", "_u", "_d", "_nth", "row", "n", "copy", "copies", "size", "kept", "digest", "count"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    wide = docs.select("*", *[F.lit("x").alias(n) for n in names])
    got = sorted((r.doc_id, r.n_tokens) for r in e.queries()["pipeline"](spark, small).collect())
    now = wide
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, small).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != "length_packing":
            assert now.columns == wide.columns and now.where(" OR ".join(f"`{n}` <> 'x'" for n in names)).isEmpty()
    assert sorted((r.doc_id, r.n_tokens) for r in now.collect()) == got
    mixed = spark.read.parquet(str(tmp_path / "source_mix")).select("doc_id", "text").collect()
    assert sorted((r.doc_id, len(pii.re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed) == got


def test_all_are_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names) and len(queries.QUERIES) == 13


PROSE = "the water of the river and the stones that lie in it are seen by those who walk along the other side in the morning "
OTHER = "there is another story that people of the village tell their children when the evening comes and the lamps are lit "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_an_id_keep_their_texts(spark):
    """No text is lost because its row shares an id with another."""
    a, b = PROSE * 3, OTHER * 3
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b.replace("village", "town", 1), "en", "s", 1)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.text for r in left) == sorted([a, b])
    # rows without an id count by their texts too, and equal rows stay once
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, a, "en", "t", 1), (3, b, "en", "s", 1), (3, b, "en", "s", 1), (4, b + "so", "en", "s", 1)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("3", b), ("None", a)]
    # as with ids of their own
    rows = [(k, r[1], *r[2:]) for k, r in enumerate(rows)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(0, a), (1, b)]


def test_rejected_rows_go_each_by_its_own_text(spark):
    rows = [(k, PROSE * 2 + str(k), "en", "s", 1) for k in range(30)] + [(None, "0123 456 " * 30, None, "s", 1), (None, PROSE * 2, None, "s", 1), (7, "99 " * 80, None, "s", 1)]
    left = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(r[0]), r[1]) for r in rows if PROSE in r[1])


def test_brute_force_of_what_the_stages_keep(spark, small):
    """The near copies that stay hold no pair at the threshold that plain word alignment finds among short texts."""
    import difflib

    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = [r.text.lower().split() for r in corpus_pipeline.near_dedup(spark, docs, small).collect() if r.text and 20 <= len(r.text.split()) <= 150]
    for i, x in enumerate(left):
        for y in left[:i]:
            if min(len(x), len(y)) >= 0.9 * max(len(x), len(y)):
                m = difflib.SequenceMatcher(None, x, y, autojunk=False)
                assert m.quick_ratio() < 0.95 or sum(b.size for b in m.get_matching_blocks()) < 0.95 * max(len(x), len(y))
