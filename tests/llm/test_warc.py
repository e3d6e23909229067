import gzip
import hashlib
import random
import shutil

import pytest

from gridpile.llm import warc
from tests.conftest import same_rows


def expected(rows):
    first, out = {}, []
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= 100:
            first[b] = min(p, first.get(b, p))
    for p, _, h in rows:
        b = (h or "").encode()
        seen = len(b) >= 100 and b in first
        revisit = seen and p != first[b]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return out


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def test_roundtrip(spark):
    """Copies, ties, repeats, nulls, payloads of 99 and 100 bytes, odd URLs, and payloads that look like records."""
    r = random.Random(1)
    trap = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "y" * 90
    bodies = ["a" * 99, "b" * 100, "é" * 50, trap, "", None, "c" * 5000, "\r\n\r\n", "d\r\n\r\n" * 30, trap + "WARC/1.1", "\r\n\r\nWARC/1.1\r\n"]
    rows = [(i, f"http://h{i % 3}.example/p q\t{i}#x", r.choice(bodies)) for i in range(80)]
    rows += [(5, None, "b" * 100), (5, "", "b" * 100), (None, "u", "b" * 100), (None, None, None), (200, "http://h", trap), (200, "http://h", trap)]
    df = spark.createDataFrame([(a, b, c, "n", "m") for a, b, c in rows], "page_id long, url string, html string, digest string, first string")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.roundtrip(df).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_archives_are_warc(spark, tmp_path):
    """The files read by an independent reader of lengths: three records a page, tied together, blocks of the stated length."""
    rows = [(i, f"http://e.example/{i}", "p" * 120 if i % 2 else f"page {i}") for i in range(10)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    kinds, ids, tied = [], set(), set()
    for f in (tmp_path / "w").glob("part*"):
        data, at = gzip.decompress(f.read_bytes()), 0
        while at < len(data):
            assert data[at : at + 10] == b"WARC/1.1\r\n"
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in data[at + 10 : end].decode().split("\r\n"))
            n = int(head["Content-Length"])
            assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
            kinds.append(head["WARC-Type"])
            ids.add(head["WARC-Record-ID"])
            tied.add(head.get("WARC-Concurrent-To"))
            at = end + 8 + n
    assert sorted(kinds) == ["metadata"] * 10 + ["request"] * 10 + ["response"] * 6 + ["revisit"] * 4
    assert len(ids) == 30 and tied - {None} <= ids


@pytest.mark.parametrize("folder", ["plain", "with space", "p%20c", "ü+&=#"])
@pytest.mark.parametrize("packed", [True, False])
def test_torn_archives_in_any_folder(spark, tmp_path, folder, packed):
    """Payloads that look like records, whatever the folder is called, also in archives that are not compressed; large ones come in pieces."""
    trap = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "y" * 90
    rows = [(1, "http://a", trap), (2, "http://b", "plain " * 40), (3, "http://c", trap * 3000), (4, "http://d", trap), (5, "http://e", "")]
    at = tmp_path / folder
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(at))
    if not packed:
        for f in at.glob("part*.gz"):
            f.with_suffix("").write_bytes(gzip.decompress(f.read_bytes()))
            f.unlink()
    got = warc.read_records(spark, str(at)).collect()
    assert len(got) == 15 and len({r.id for r in got}) == 15
    bodies = sorted(bytes(r.block).split(b"\r\n\r\n", 1)[1] for r in got if r.type == "response")
    assert bodies == sorted(x.encode() for x in ("", trap, "plain " * 40, trap * 3000))
    revisit = next(r for r in got if r.type == "revisit")
    assert any(r.id == revisit.refers_to and r.type == "response" and r.digest == revisit.digest for r in got)


@pytest.mark.parametrize("packed", [True, False])
def test_torn_archives_keep_their_order(spark, tmp_path, packed):
    """Many torn archives, in many splits where they are plain, with every join shuffled and sorting in small runs."""
    trap = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "y" * 90
    rows = [(i, f"http://{i}", f"<{i}>" + (trap * (i % 40 + 1) if i % 3 else "plain " * i)) for i in range(300)]
    at = tmp_path / "w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(12), str(at))
    if not packed:
        for f in at.glob("part*.gz"):
            f.with_suffix("").write_bytes(gzip.decompress(f.read_bytes()))
            f.unlink()
    put = {"spark.sql.files.maxPartitionBytes": "7000", "spark.sql.files.openCostInBytes": "1000", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in put}
    shuffled, warc.broadcast_if_small = warc.broadcast_if_small, lambda df, *a: df
    try:
        for k, x in put.items():
            spark.conf.set(k, x)
        read = warc.read_records(spark, str(at))
        assert "BroadcastHashJoin" not in read._jdf.queryExecution().executedPlan().toString()
        got = read.where("type = 'response'").collect()
    finally:
        warc.broadcast_if_small = shuffled
        for k, x in before.items():
            spark.conf.set(k, x)
    assert sorted(bytes(r.block).split(b"\r\n\r\n", 1)[1] for r in got) == sorted(h.encode() for _, _, h in rows)


@pytest.mark.parametrize("payload", ["plain " * 40, "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "y" * 90])
def test_archives_are_read_once(spark, tmp_path, payload):
    """What transactions need of the records is there without the archives, whole and torn ones."""
    at = tmp_path / "w"
    warc.write_archives(spark.createDataFrame([(i, f"http://{i}", f"{i}{payload}" if i else None) for i in range(9)], "page_id long, url string, html string").repartition(2), str(at))
    plain = {(r.type, r.id): bytes(r.block) for r in warc.read_records(spark, str(at)).collect()}
    facts = warc.read_records(spark, str(at), facts=True)
    shutil.rmtree(at)
    got = facts.collect()
    assert len(got) == len(plain) == 27
    for r in got:
        whole = plain[r.type, r.id]
        if r.type == "response":
            body = whole.split(b"\r\n\r\n", 1)[1]
            assert (r.bytes, r.sha256, r.block) == (len(body), hashlib.sha256(body).hexdigest(), None)
        else:
            assert (r.bytes, r.sha256, r.block) == (None, None, whole.decode())


def test_transactions(spark):
    """Ties in either direction, over a record between, several of a kind, none, and loose or repeated records."""
    body = bytearray(b"HTTP/1.1 200 OK\r\n\r\nbody")
    rows = [("response", "r1", None, "sha256:x", body), ("request", "q1", "r1", None, bytearray(b"GET")), ("metadata", "m1", "q1", None, bytearray(b"m")), ("metadata", "m0", "r1", None, bytearray(b"n")),
            ("response", "r2", "q2", None, body), ("request", "q2", None, None, bytearray(b"G2")), ("response", "r3", None, None, bytearray(b"no end")), ("request", "q9", "gone", None, None), ("request", "q1", "r1", None, bytearray(b"GET")), ("warcinfo", "w", None, None, None)]
    rows = [(*r[:3], None, *r[3:]) for r in rows]
    got = {r.id: r for r in warc.transactions(spark.createDataFrame(rows, "type string, id string, concurrent_to string, refers_to string, digest string, block binary")).collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert got["r1"].request.id == "q1" and got["r1"].metadata.id == "m0" and got["r1"].further == 1 and got["r1"].response.bytes == 4
    assert got["r1"].response.sha256 == hashlib.sha256(b"body").hexdigest()
    assert got["r2"].request.block == "G2" and got["r2"].metadata is None and got["r3"].request is None and got["r3"].response.bytes == 0


def test_equals_sql(spark, small, duck):
    from gridpile.llm import queries

    same_rows(queries.QUERIES["op4_warc_transactions"](spark, small), duck, queries.ORACLE["op4_warc_transactions"])
