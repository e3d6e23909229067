"""The corpus operators' queries with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosspoly, fingerprint, langid, maxent, mixing, omh, packing, pii, ranked, repeats, toolcalls, variants, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_calls(*toolcalls.conversation_calls(_table(spark, sf_dir, "conversations")), toolcalls.REPLY)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(_table(spark, sf_dir, "documents"))


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents (doc_id) and of all pages (page_id), by one model fitted on labelled documents."""
    documents, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = langid.fit(documents)
    of_docs = langid.identify(langid.document_evidence(documents), model, "lang-documents")
    of_pages = langid.identify(langid.page_evidence(pages), model, "lang-pages", entities=True)
    none = F.lit(None).cast("bigint")
    return of_docs.withColumn("page_id", none).unionByName(of_pages.withColumn("doc_id", none))


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_window_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_scaled_sketch, op2_tool_calls, op3_source_mix, op4_warc_transactions, op5_order_minhash, op6_maxent_lm, op7_language_fusion, op8_length_buckets, op9_pii_spans, op10_cross_polytope, op11_window_search, op12_spelling_variants, op13_suffix_dedup)}

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWERED.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _crc_step(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


#: What the last four bits of a CRC-32 add to the rest.
_CRC = str([_crc_step(c) for c in range(16)])
_BYTES = "hex(encode(id || ':' || run))"

ORACLE = {
    "op4_warc_transactions": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op10_cross_polytope": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS to_node FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.to_node = l.a),
low AS (SELECT node, min(to_node) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE a = e.vec_id) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN low ON node = e.vec_id""",
    "op11_window_search": f"""
WITH words AS (
  SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
wanted AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
sizes AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY doc_id),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tfs AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words SEMI JOIN wanted USING (term) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, whole GROUP BY term),
gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS gain FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (term), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM wanted JOIN gains USING (term) GROUP BY item_id, doc_id HAVING sum(gain) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op12_spelling_variants": f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_LOWERED.format("unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c FROM runs GROUP BY id, run),
-- CRC-32, four bits at a time
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(length({_BYTES}) // 2 AS BIGINT) + 1), lambda i: CAST(('0x' || substr({_BYTES}, CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))),
  lambda a, b: xor(xor(xor(a, b) >> 4, {_CRC}[(xor(a, b) & 15) + 1]) >> 4, {_CRC}[(xor(xor(a, b) >> 4, {_CRC}[(xor(a, b) & 15) + 1]) & 15) + 1]))) AS h
  FROM counted),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
near AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, max(other_n) AS m, arg_min(other, (-other_n, other)) AS o FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN o END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN near USING (word)),
way AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON f.word = way.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, way.at AS root FROM forms f JOIN way ON way.word = f.word AND way.next IS NULL""",
}
