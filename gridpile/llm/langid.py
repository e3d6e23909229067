"""Language identification by Bayesian fusion: text likelihood, declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

import html
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, stored, text_or_empty

UNKNOWN = "und"
CELLS = 1 << 13
#: The classifier is fitted on about so many labelled rows, an even part of them for each language, chosen by a hash of id and text.
FIT_ROWS = 20_000
#: Trigrams of a text overlap and repeat, so their log likelihood counts for a fraction of itself.
TEMPER = 0.25
#: Pseudo-counts that tie a host to its domain, a domain to the whole, and the tables of declared languages and suffixes to uniform.
TIE, EVEN = 20.0, 1.0
LEAST_CONFIDENCE = 0.5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B, dtype=np.uint8)
_SLICE = 1 << 21


def _trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, cell, number of rows) of the folded byte trigrams of a batch, in slices; those of two or three spaces and across rows are left out."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)
    for at in range(int(offsets[0]), int(offsets[-1]), _SLICE):
        end = min(at + _SLICE + 2, int(offsets[-1]))
        b = _FOLD[raw[at:end]].astype(np.uint32)
        if len(b) < 3:
            continue
        place = np.arange(at, at + len(b) - 2)
        row = np.searchsorted(offsets, place, "right") - 1
        spaces = b == 0x20
        ok = (place + 2 < offsets[row + 1]) & ~(spaces[:-2] & spaces[1:-1]) & ~(spaces[1:-1] & spaces[2:])
        cell = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(19)
        yield row[ok], cell[ok].astype(np.int64), n


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigram cells, from a bounded sample of rows (doc_id, text, lang); the last is UNKNOWN, which holds all cells alike.

    Every language that occurs has its share of fit_rows, or all its rows if it has fewer, so rare languages are known too.
    Null languages are no labels, null texts are empty; repeated rows are chosen together; without labels only UNKNOWN is known.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty("text").alias("text"))
    # one row a language
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = sizes.select("lang", (F.lit(float(fit_rows)) / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy(F.lit(1)))) / F.col("n")).alias("share"))
    rows = rows.join(F.broadcast(stored(sizes, "langs")), "lang")
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 20)) <= F.col("share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for row, cell, _ in _trigrams(b.column(1)):
                for lang in set(langs[np.unique(row)]):
                    part = np.bincount(cell[langs[row] == lang], minlength=CELLS)
                    seen[lang] = seen[lang] + part if lang in seen else part
        for lang, c in seen.items():
            i = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(c[i].astype(np.int64))], ["lang", "cell", "n"])

    # at most CELLS rows a language reach the driver
    counts = rows.select("lang", "text").mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs) + 1, CELLS), -math.log(CELLS))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        c = np.bincount(own["cell"], weights=own["n"], minlength=CELLS) + 0.1
        table[i] = np.log(c / c.sum())
    return [*langs, UNKNOWN], table


def text_likelihoods(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", entities: bool = False) -> DataFrame:
    """Replaces text by array ll, the log likelihoods of the whole text in each of the model's languages, and trigrams, their number.

    entities: HTML character references in the text stand for their characters.
    """
    langs, table = model
    i = df.columns.index(text)
    schema = df.drop(text).withColumns({"ll": F.array(F.lit(0.0)), "trigrams": F.lit(0).cast("bigint")}).schema
    columns = np.ascontiguousarray(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, seen = np.zeros((b.num_rows, len(langs))), np.zeros(b.num_rows, np.int64)
            texts = b.column(i)
            if entities:
                texts = pa.array([html.unescape(t) if t and "&" in t else t for t in texts.to_pylist()], pa.large_string())
            for row, cell, n in _trigrams(texts):
                if len(row):
                    low, high = int(row[0]), int(row[-1]) + 1
                    seen[low:high] += np.bincount(row - low, minlength=high - low)
                    for k in range(len(langs)):
                        total[low:high, k] += np.bincount(row - low, weights=columns[k][cell], minlength=high - low)
            rest = [c for j, c in enumerate(b.columns) if j != i]
            ll = pa.ListArray.from_arrays(np.arange(0, total.size + 1, len(langs), dtype=np.int32), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*rest, ll, pa.array(seen)], schema.names)

    return df.mapInArrow(run, schema)


def page_evidence(pages: DataFrame) -> DataFrame:
    """From (page_id, url, html): the visible text, and what the page says of its language: declared, suffix, host and domain; any may be null."""
    page = F.coalesce("html", F.lit(""))
    # what is never closed hides the rest of the page, so every character is looked at once
    visible = F.regexp_replace(page, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.when(host == "", None).otherwise(host)
    code = F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1)
    declared = F.lower(F.regexp_extract(page, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), visible.alias("text"), F.when(declared != "", declared).alias("declared"),
        F.concat(F.substring_index(host, ".", -1), F.lit("/"), F.lower(code)).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"))


def document_evidence(documents: DataFrame, **more: Column) -> DataFrame:
    """Documents have no address: their source stands for host and domain, and what markup their text has for a declaration. more: columns to carry along."""
    declared = F.lower(F.regexp_extract(text_or_empty("text"), r"""(?i)<html\b[^>]{0,200}?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    source = F.col("source").cast("string")
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"), F.when(declared != "", declared).alias("declared"),
        F.lit(None).cast("string").alias("suffix"), source.alias("host"), source.alias("domain"), *[c.alias(n) for n, c in more.items()])


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], name: str = "langid", entities: bool = False) -> DataFrame:
    """Adds lang, confidence, text_lang and kept to rows (any columns, text, declared, suffix, host, domain); text goes.

    log posterior = TEMPER * text likelihood + log P(declared | language) + log P(suffix | language) + log host prior.
    The tables come from grouped aggregation of the text-only decisions: counts by declared language and by suffix, each
    smoothed to uniform, and by host, smoothed to its domain, which is smoothed to all rows; a row's own decision is taken
    out of its host's counts. Absent evidence adds nothing. UNKNOWN takes texts that no language explains better than chance,
    such as texts without letters; they, and rows whose best language has less than LEAST_CONFIDENCE, are not kept. Of equal
    scores the first language counts. Repeated rows count as often as they occur and get equal results; an empty table gives
    an empty result; whole texts of any length are read. The tables have a row for each value, and the joins with them split
    hot hosts where tables are too large to broadcast (adaptive execution).
    """
    langs, _ = model
    n = len(langs)
    rows = text_likelihoods(rows, model, entities=entities)
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    rows = stored(rows.withColumn("guess", F.when(F.col("trigrams") > 0, best(F.col("ll"))).otherwise(n - 1)), name)
    # a host's domain is a function of the host, so hosts has one row a host
    votes = rows.groupBy("declared", "suffix", "host", "domain", "guess").agg(F.count("*").alias("c"))
    votes = stored(votes, f"{name}-votes")
    each = [F.sum(F.when(F.col("guess") == i, F.col("c")).otherwise(0)).cast("double") for i in range(n)]
    overall = votes.agg(F.array(*each).alias("v")).first().v or [0.0] * n
    overall = [x or 0.0 for x in overall]
    prior = [(x + 1.0) / (sum(overall) + n) for x in overall]

    def likelihood(of: str) -> DataFrame:
        """log P(value | language) of each value, all in one row of a small table for each value."""
        table = votes.where(F.col(of).isNotNull()).groupBy(of).agg(F.array(*each).alias("v"))
        total = table.agg(F.array(*[F.sum(F.col("v")[i]) for i in range(n)]).alias("t"), F.count("*").alias("k")).first()
        t, k = [x or 0.0 for x in total.t], total.k
        return table.select(of, F.array(*[F.log((F.col("v")[i] + EVEN) / F.lit(t[i] + EVEN * max(1, k))) for i in range(n)]).alias(f"by_{of}"))

    domains = votes.groupBy("domain").agg(F.array(*each).alias("d")).where("domain is not null")
    hosts = votes.groupBy("host", "domain").agg(F.array(*each).alias("h")).where("host is not null")
    hosts = hosts.join(domains, "domain", "left")
    out = rows.join(broadcast_if_small(likelihood("declared")), "declared", "left").join(broadcast_if_small(likelihood("suffix")), "suffix", "left")
    out = out.join(broadcast_if_small(hosts.select("host", "h", "d")), "host", "left")
    own = lambda i: F.when(F.col("guess") == i, 1.0).otherwise(0.0)
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    in_domain = [(F.coalesce(F.col("d")[i], F.lit(0.0)) - F.when(F.col("d").isNotNull(), own(i)).otherwise(0.0) + TIE * prior[i]) for i in range(n)]
    of_domain = F.coalesce(sums(F.col("d")) - 1.0, F.lit(0.0)) + TIE
    in_host = [(F.coalesce(F.col("h")[i], F.lit(0.0)) - F.when(F.col("h").isNotNull(), own(i)).otherwise(0.0) + TIE * in_domain[i] / of_domain) for i in range(n)]
    score = [TEMPER * F.col("ll")[i] + F.log(F.greatest(in_host[i], F.lit(1e-9))) + F.coalesce(F.col("by_declared")[i], F.lit(0.0)) + F.coalesce(F.col("by_suffix")[i], F.lit(0.0)) for i in range(n)]
    # a text without trigrams has no evidence in its text: its language stays unknown
    out = out.withColumn("score", F.array(*score))
    top = F.array_max("score")
    share = 1.0 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    out = out.withColumn("pick", F.when(F.col("trigrams") > 0, best(F.col("score"))).otherwise(n - 1)).withColumn("confidence", F.when(F.col("trigrams") > 0, share).otherwise(0.0))
    names = F.array(*[F.lit(x) for x in langs])
    lang = F.element_at(names, F.col("pick") + 1)
    known = (F.col("pick") < n - 1) & (F.col("confidence") >= LEAST_CONFIDENCE)
    extra = [c for c in rows.columns if c not in ("ll", "trigrams", "guess", "declared", "suffix", "host", "domain")]
    return out.select(*extra, lang.alias("lang"), F.col("confidence"), F.element_at(names, F.col("guess") + 1).alias("text_lang"), known.alias("kept"), "declared", "suffix", "host")
