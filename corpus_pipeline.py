"""From raw documents to training batches: language ID, near-dedup, PII, source mix, packing.

Each stage works on all that its predecessor kept and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpile.llm import langid, mixing, omh, packing, pii
from gridpile.llm.common import broadcast_if_small, stored, text_or_empty


def _free(docs: DataFrame, name: str) -> str:
    """name, or one like it that no column of docs has."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _digest() -> Column:
    """128 bits of the text; null is empty."""
    return F.unhex(F.substring(F.sha2(text_or_empty("text"), 256), 1, 32))


def _row() -> Column:
    """What a row's language is decided by: its id, source and text."""
    return F.struct(F.col("doc_id").cast("bigint").alias("i"), F.col("source").cast("string").alias("s"), _digest().alias("d"))


def _without(docs: DataFrame, gone: DataFrame, key: Column, name: str) -> DataFrame:
    """docs without the rows whose key is in the one column of gone; the texts are shuffled only if those are too many to broadcast."""
    own = _free(docs, "_gone")
    gone = broadcast_if_small(stored(gone.toDF(own), name), 1_000_000)
    return docs.join(gone, key.eqNullSafe(F.col(own)), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go, each row by its own text and source, whatever ids repeat or are null. Null, empty and
    letterless texts go; texts of any length are read whole; equal rows stay or go together; an empty table stays empty."""
    found = langid.identify(langid.document_evidence(docs, row=_row()), langid.fit(docs), "pipeline-lang")
    return _without(docs, found.where("not kept").select("row").distinct(), _row(), "rejected")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: that with the smallest doc_id, null last, then of the least digest of its text.
    Rows count by their texts, so of rows that share an id, or have none, each text's class keeps one. Null texts equal empty
    ones; whole texts are compared; an empty table stays empty."""
    ids = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest().alias("digest")), "dedup-ids")
    if ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _without(docs, omh.near_duplicates(docs).where("not kept").select("doc_id"), F.col("doc_id").cast("bigint"), "copies")
    # ids do not tell rows apart: every different text gets a number of its own
    numbers = stored(ids.select("digest").distinct().withColumn("number", F.monotonically_increasing_id()), "text-numbers")
    texts = docs.select(_digest().alias("digest"), text_or_empty("text").alias("text")).dropDuplicates(["digest"])
    texts = stored(texts.join(numbers, "digest").select(F.col("number").alias("doc_id"), "text"), "numbered-texts")
    classes = omh.near_duplicates(texts).select(F.col("doc_id").alias("number"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    stays = ids.join(numbers, "digest").join(classes, "number").groupBy("class_id").agg(first)
    stays = stored(stays.select(F.struct(F.col("first.doc_id").alias("i"), F.col("first.digest").alias("d")).alias("key")), "first-of-class")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").cast("bigint").alias("i"), _digest().alias("d")).alias("key"), F.xxhash64("source", "lang", "n_chars").alias("rest"))
    left = rows.join(stays, "key", "left_semi")
    # of rows of one id and text that of the least hash of the other columns, once
    least = left.groupBy("key").agg(F.min("rest").alias("rest"))
    return left.join(least, ["key", "rest"], "left_semi").dropDuplicates(["key"]).select("row.*")


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text, whole, gives way to the name of its kind. Null texts stay null, rows are never dropped."""
    return pii.redact_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times; some are left out. Of equal rows so many are taken, whichever.
    Null texts have no words, a null source is a source; an empty table stays empty."""
    return mixing.apply_mix(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every document; equal rows have a slot each, null and empty texts length 0; an empty table gives none."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("remove_pii", remove_pii), ("source_mix", source_mix), ("length_packing", length_packing)]

#: Alignment of candidates, detection of disguises and dynamic programming have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
