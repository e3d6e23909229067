"""WARC archives through Spark's text source, and transactions assembled from their records.

A record is a header, CRLF CRLF, a block and CRLF CRLF. Written with that as the line separator and read with the next
record's version line as the separator, archives stream through Spark's own writer and reader, on any file system it knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, scratch_path, stored

CRLF = "\r\n"
VERSION = "WARC/1.1"
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


def _record(kind: Column | str, rid: Column, uri: Column, block: Column, *fields: Column, content: str) -> Column:
    """One record without its closing CRLF CRLF; fields are further header lines, null ones are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), rid, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), uri),
             F.lit(f"WARC-Date: {DATE}"), *fields, F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def _dashed(h: str) -> Column:
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of pages (page_id, url, html).

    Of rows with equal payloads of at least LEAST_REVISIT bytes those with the smallest page_id are responses; the others are
    revisits, which name the response by WARC-Refers-To and have its digest in place of the payload. Where rows repeat that
    smallest page_id, revisits have the digest alone. Null html is an empty payload, a null url an empty URI. An archive is
    one gzip stream, as Spark's writer makes it, not a stream for each record.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT)
    each = large.groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    firsts = each.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))["n"].alias("of_first"))
    firsts = firsts.where("n > 1").select("digest", "first", (F.col("of_first") == 1).alias("alone"))
    firsts = stored(firsts, "warc-firsts")
    rows = rows.join(broadcast_if_small(firsts), "digest", "left")
    first = F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull())  # a null id never is the first of others
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "+")
    seed = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"), F.monotonically_increasing_id().cast("string"))
    # hashes and identifiers are columns of their own, so each is made once for a row
    rows = rows.withColumns({"is_first": first, "seed": seed})
    original = F.concat(F.lit("original|"), F.col("digest"))
    rows = rows.withColumns({
        "_r": F.md5(F.when(F.col("is_first") & F.col("alone"), original).otherwise(F.concat(F.col("seed"), F.lit("|response")))), "_q": F.md5(F.concat(F.col("seed"), F.lit("|request"))),
        "_m": F.md5(F.concat(F.col("seed"), F.lit("|metadata"))), "_o": F.when(~F.col("is_first") & F.col("alone"), F.md5(original))})
    rows = rows.withColumns({"rid": _dashed("_r"), "qid": _dashed("_q"), "mid": _dashed("_m"), "uri": uri})
    rid, qid, mid, uri = (F.col(c) for c in ("rid", "qid", "mid", "uri"))
    refers = F.when(F.col("_o").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _dashed("_o"), F.lit(">")))
    near = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), rid, F.lit(">"))
    host = F.regexp_extract(uri, r"^\w+://([^/?#]*)", 1)
    target = F.coalesce(F.nullif(F.regexp_extract(uri, r"^\w+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    request = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(CRLF * 2))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    response = F.concat(head, F.when(F.col("is_first"), F.col("html")).otherwise(F.lit("")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    profile = F.when(~F.col("is_first"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    facts = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    out = rows.select(F.explode(F.array(
        _record("request", qid, uri, request, near, content="application/http;msgtype=request"),
        _record(F.when(F.col("is_first"), "response").otherwise("revisit"), rid, uri, response, profile, refers, digest, content="application/http;msgtype=response"),
        _record("metadata", mid, uri, facts, near, content="application/warc-fields"),
    )).alias("value"))
    # files are as many as the tasks
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


_SCHEMA = "type string, id string, concurrent_to string, refers_to string, digest string, block binary"
_NAMES = ["WARC-Type", "WARC-Record-ID", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Payload-Digest"]
_SEPARATOR = f"{CRLF * 2}{VERSION}{CRLF}"


def _fields(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.nullif(F.regexp_replace(found, r"^<(?:urn:uuid:)?|>$", ""), F.lit(""))


def _field(header: str, name: str) -> str | None:
    found = re.search(rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", header)
    return (re.sub(r"^<(?:urn:uuid:)?|>$", "", found[1]) or None) if found else None


class _Stream:
    """Records of one archive by their Content-Length, from its bytes in order; holds no more than a record and a piece."""

    def __init__(self) -> None:
        self.rest = bytearray()

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.rest += piece
        at = 0
        while (start := self.rest.find(b"WARC/", at)) >= 0 and (end := self.rest.find(b"\r\n\r\n", start)) >= 0:
            header = self.rest[start:end].decode("utf-8", "replace")
            stop = end + 4 + int(_field(header, "Content-Length") or 0)
            if stop > len(self.rest):
                break
            yield (*(_field(header, n) for n in _NAMES), bytes(self.rest[end + 4 : stop]))
            at = stop
        del self.rest[:at]


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size > 1 << 20 or len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in held], pa.binary() if j == len(names) - 1 else pa.string()) for j in range(len(names))], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in held], pa.binary() if j == len(names) - 1 else pa.string()) for j in range(len(names))], names)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of archives from the rows (file, value) between separators, in the order that they have in the file."""

    def rows() -> Iterator[tuple]:
        file, stream = None, _Stream()
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != file:
                    file, stream = name, _Stream()
                    yield from stream.feed(value)
                else:
                    yield from stream.feed(_SEPARATOR.encode() + value)

    yield from _batched(rows())


def _facts(records: DataFrame, *others: str) -> DataFrame:
    """What transactions need of each record: for captures bytes and sha256 of the payload, for requests and metadata the block as text."""
    capture = F.col("type").isin("response", "revisit")
    body = F.expr("substring(block, octet_length(substring_index(cast(block as string), '\\r\\n\\r\\n', 1)) + 5)")
    records = records.withColumn("body", F.when(capture, body))
    return records.select(*others, "type", "id", "concurrent_to", "refers_to", "digest", F.octet_length("body").cast("bigint").alias("bytes"), F.sha2("body", 256).alias("sha256"), F.when(F.col("type").isin("request", "metadata"), F.col("block").cast("string")).alias("block"))


def read_records(spark: SparkSession, path: str, facts: bool = False) -> DataFrame:
    """All records of the archives in a folder: type, id, concurrent_to, refers_to, digest, block; with facts, what _facts gives of
    them, which is stored as archives are read, so that they are read and parsed once.

    Archives are read record by record. A block that itself holds the text between two records would be cut there; its length
    then differs from Content-Length, and the archives where that happens are read again by the lengths alone, as a stream of
    their pieces sorted by their split's start and their place in the split. A task holds a record and a piece at a time,
    whatever the archive's size and whether it is compressed. A record has to fit a value (2 GB). Empty archives and a folder
    without records give no rows.
    """
    lines = spark.read.option("lineSep", _SEPARATOR).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    header = F.substring_index("value", CRLF * 2, 1)
    parts = lines.withColumn("header", header).withColumn("length", _fields(F.col("header"), "Content-Length").cast("bigint"))
    body = F.expr("substring(cast(value as binary), octet_length(header) + 5)")
    parts = parts.withColumn("block", body).withColumn("after", F.octet_length("block") - F.col("length"))
    # the last record of a file still has its closing CRLF CRLF
    ended = (F.col("after") == 4) & (F.expr("substring(block, cast(length as int) + 1)") == F.lit(b"\r\n\r\n"))
    whole = F.coalesce((F.col("after") == 0) | ended, F.lit(False))
    get = lambda n: _fields(F.col("header"), n)
    kinds = [k.split()[0] for k in _SCHEMA.split(", ")]
    # few records refer to others: most headers need not be searched for it
    of = lambda n: F.when(F.lower("header").contains(n.lower()), get(n)) if n == "WARC-Refers-To" else get(n)
    block = F.when(F.col("whole"), F.expr("substring(block, 1, cast(length as int))"))
    parts = parts.withColumn("whole", whole).withColumn("torn", ~F.col("whole") & (F.length(F.trim("value")) > 0))
    parts = parts.select("file", "whole", "torn", *[of(n).alias(k) for n, k in zip(_NAMES, kinds, strict=False)], block.alias("block"))
    if facts:
        parts = stored(_facts(parts.where("whole or torn"), "file", "whole", "torn"), "warc-facts")
    columns = [c for c in parts.columns if c not in ("file", "whole", "torn")]
    torn = stored(parts.where("torn").select("file").distinct(), "warc-torn")
    if torn.isEmpty():
        return parts.where("whole").select(*columns)
    names = broadcast_if_small(torn)
    good = parts.where("whole").join(names, "file", "left_anti").select(*columns)
    # one task reads a split from its start to its end, so rows of a split are numbered in their order
    pieces = lines.withColumn("place", F.monotonically_increasing_id()).join(names, "file", "left_semi").repartition("file").sortWithinPartitions("file", "split", "place")
    again = pieces.select("file", F.col("value").cast("binary").alias("value")).mapInArrow(_in_order, _SCHEMA)
    return good.unionByName(stored(_facts(again), "warc-facts") if facts else again)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: id, response, request, metadata, further.

    A capture is a response or revisit with the records that WARC-Concurrent-To ties to it, in either direction or over one
    record in between. Of several requests or metadata records the one with the smallest id is shown and `further` counts
    the rest. Records tied to no capture are left out; repeated records of one id and type count once.
    """
    return _assembled(_facts(records))


def _assembled(facts: DataFrame) -> DataFrame:
    captures = facts.where("type in ('response', 'revisit')").select("id", "type", "digest", "concurrent_to", "refers_to", "bytes", "sha256")
    captures = stored(captures.dropDuplicates(["id"]), "warc-captures")
    small = facts.where("type in ('request', 'metadata')").select("id", "type", "concurrent_to", "block")
    small = stored(small.dropDuplicates(["id", "type"]), "warc-small")
    ids = captures.select(F.col("id").alias("capture"))
    direct = small.join(ids, F.col("concurrent_to") == F.col("capture"))
    back = small.join(captures.select(F.col("concurrent_to").alias("to"), F.col("id").alias("capture")).where("to is not null"), F.col("id") == F.col("to")).drop("to")
    tied = direct.select("capture", "id", "type", "block").unionByName(back.select("capture", "id", "type", "block"))
    loose = small.join(tied.select("id"), "id", "left_anti").where("concurrent_to is not null")
    between = tied.select(F.col("id").alias("via"), "capture")
    tied = tied.unionByName(loose.join(between, F.col("concurrent_to") == F.col("via")).select("capture", "id", "type", "block"))
    tied = tied.dropDuplicates(["capture", "id", "type"])
    pick = lambda t: F.min(F.when(F.col("type") == t, F.struct("id", "block")))
    sides = tied.groupBy("capture").agg(pick("request").alias("request"), pick("metadata").alias("metadata"), F.count("*").alias("tied"))
    out = captures.join(sides, F.col("id") == F.col("capture"), "left")
    shown = F.when(F.col("request").isNotNull(), 1).otherwise(0) + F.when(F.col("metadata").isNotNull(), 1).otherwise(0)
    return out.select("id", F.struct("type", "digest", "refers_to", "bytes", "sha256").alias("response"), "request", "metadata", (F.coalesce("tied", F.lit(0)) - shown).alias("further"))


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back and reports each capture.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Rows that share the smallest page_id of equal payloads are
    all responses; other rows of that payload, also with a null page_id, are revisits. Repeated rows are captures of their own.
    Null html is an empty payload, a null url an empty URI; an empty table gives no rows; other columns are ignored. A payload
    goes through whole, up to Spark's 2 GB for a value.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    got = _assembled(read_records(spark, path, facts=True))
    got = got.select(
        F.nullif(F.regexp_extract(F.col("metadata.block"), r"(?m)^page-id: (-?\d+)", 1), F.lit("")).cast("bigint").alias("page_id"), "id",
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers"), F.regexp_replace("response.digest", "^sha256:", "").alias("digest"), F.col("response.bytes").alias("bytes"), F.col("response.sha256").alias("sha256"))
    got = stored(got, "warc-read")
    responses, revisits = got.where("record_type = 'response'"), got.where("record_type = 'revisit'").select("page_id", "digest", "refers")
    # a revisit has its payload's size from the response that it refers to, by record or, without that, by digest
    named = broadcast_if_small(revisits.select(F.col("refers").alias("id")).where("id is not null").distinct())
    by_id = stored(responses.join(named, "id", "left_semi").select(F.col("id").alias("refers"), F.col("page_id").alias("first"), F.col("bytes").alias("full")), "warc-originals")
    found = revisits.where("refers is not null").join(broadcast_if_small(by_id), "refers").select("page_id", "digest", "first", "full")
    unnamed = revisits.where("refers is null")
    digests = broadcast_if_small(unnamed.select(F.col("digest").alias("sha256")).distinct())
    by_digest = stored(responses.join(digests, "sha256", "left_semi").groupBy(F.col("sha256").alias("digest")).agg(F.min("page_id").alias("first"), F.min("bytes").alias("full")), "warc-originals")
    found = found.unionByName(unnamed.join(broadcast_if_small(by_digest), "digest").select("page_id", "digest", "first", "full"))
    shown = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    return shown.unionByName(found.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to")))
