"""BAM files in splits, and the jobs that read them."""

import random
import struct

import pytest

from gridpile import __main__ as cli
from gridpile import jobs
from gridpile.sources import bam, matrices

CHROMS = [("1", 4_999_999), ("2", 2_999_999), ("chrUn_x", 77)]
SCHEMA = "flag int, c1 string, p1 bigint, c2 string, p2 bigint, filters int"


def made(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        (c1, n1), (c2, n2) = r.choice(CHROMS[:2]), r.choice([*CHROMS[:2], ("*", 0)])
        out.append((65, c1, r.randrange(1, n1), c2, r.randrange(1, n2) if n2 else 0, r.randrange(0, 1024)))
    return out


def rows(df):
    return sorted((r.flag, r.c1, r.p1, r.c2, r.p2, r.filters) for r in df.collect())


@pytest.mark.parametrize("block, split", [(65_280, 1 << 26), (500, 2_000), (61, 9_000)])
def test_splits_give_every_read_once(spark, tmp_path, block, split):
    """Records run over blocks of any size, and splits begin anywhere, inside headers and records too."""
    want = made(1, 600)
    path = str(tmp_path / "x")
    assert bam.write_bam(spark.createDataFrame(want, SCHEMA).repartition(2), CHROMS, path, block_bytes=block) == 2
    got = bam.read_bam(spark, path, "XF", split)
    assert rows(got) == sorted(want)
    assert got.rdd.getNumPartitions() >= (4 if split < 1 << 20 else 2)
    assert [tuple(r) for r in bam.bam_sizes(spark, path).orderBy("ord").collect()] == [(i, *c) for i, c in enumerate(CHROMS)]


def test_long_records_tags_and_damage(spark, tmp_path):
    """Records longer than several blocks, all kinds of tags before the one asked for; damage is told."""
    tags = b"NMC\x05XSA!ABZhello world\0CDHBEEF\0EFBS" + struct.pack("<I3H", 3, 1, 2, 3) + b"GHf" + struct.pack("<f", 1.5) + b"XFs" + struct.pack("<h", 300)
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 10_000_000)
    data = bytearray(head)
    for k in range(40):
        name, length = b"read%d\0" % k, 9_001
        body = struct.pack("<iiBBHHHiiii", 0, 100 * k, len(name), 7, 0, 2, 65, length, 0, 5 + k, 0) + name + bytes(8) + bytes((length + 1) // 2) + b"\x1e" * length + tags
        data += struct.pack("<i", len(body)) + body
    blocks = [bam._packed(bytes(data[i : i + 4_000])) for i in range(0, len(data), 4_000)]
    path = tmp_path / "long.bam"
    path.write_bytes(b"".join(blocks) + bam.END)
    for split in (1_000, 1 << 26):
        got = sorted((r.p1, r.p2, r.mapq, r.filters, r.c1) for r in bam.read_bam(spark, str(path), "XF", split).collect())
        assert got == [(100 * k + 1, 6 + k, 7, 300, "1") for k in range(40)]
    assert {r.filters for r in bam.read_bam(spark, str(path)).collect()} == {0}
    broken = bytearray(b"".join(blocks) + bam.END)
    broken[len(broken) // 2] ^= 0xFF
    (tmp_path / "broken.bam").write_bytes(broken)
    with pytest.raises(Exception):
        bam.read_bam(spark, str(tmp_path / "broken.bam")).collect()
    (tmp_path / "empty.bam").write_bytes(bam._packed(head) + bam.END)
    assert bam.read_bam(spark, str(tmp_path / "empty.bam")).count() == 0
    with pytest.raises(FileNotFoundError):
        bam.bam_files(str(tmp_path / "none.bam"))


def test_default_filters_and_window_of_the_counting_job(spark, tmp_path):
    """The same reads as SAM text and as BAM: reads without the tag stay, those with an excluded filter go, the window holds."""
    reads = [(65, "1", 10_001 * (1 + k % 9), "1", 10_001 * (1 + k % 9) + 20_000 * (k % 3), 0) for k in range(90)] + [(65, "1", 5, "2", 7, 16), (65, "1", 5, "2", 7, 4), (65, "2", 10_005, "1", 7, 1)]
    lines = [f"@SQ\tSN:{c}\tLN:{n}" for c, n in CHROMS]
    lines += [f"r\t{f}\t{c1}\t{p1}\t60\t5M\t{c2}\t{p2}\t0\t*\t*" + (f"\tNM:i:0\tXF:i:{x}" if x else "") for f, c1, p1, c2, p2, x in reads]
    (tmp_path / "r.sam").write_text("\n".join(lines) + "\n")
    bam.write_bam(spark.createDataFrame(reads, SCHEMA), CHROMS, str(tmp_path / "r"))
    for window, n in (("all", 91), ("intra", 90), ("inter", 1), ("19000-21000", 30)):
        sums = set()
        for source in ("r.sam", "r"):
            out = str(tmp_path / f"{window}-{source}")
            jobs.count_reads(spark, str(tmp_path / source), out, 10_000, window=window)
            m = matrices.read_matrix(spark, out).collect()
            sums.add(frozenset(map(tuple, m)))
            assert sum(r.raw for r in m) == n
        assert len(sums) == 1


def test_command_line(spark, tmp_path):
    """Count, peaks, merge and predict from a matrix in one file, by arguments."""
    at = lambda name: str(tmp_path / name)
    bam.write_bam(spark.createDataFrame(made(4, 3_000), SCHEMA).where("c2 <> '*'"), CHROMS, at("reads"))
    cli.main(["count", "--reads", at("reads"), "--out", at("matrix"), "--resolution", "50000", "--exclude", "", "--bad", "3,7"], spark)
    body = [r.value for r in spark.read.text(at("matrix") + "/body").collect()]
    (tmp_path / "one.tsv").write_text("".join(f"# CHROM\t{c}\t{n}\n" for c, n in CHROMS) + "# RESOLUTION\t50000\n# BADCOLS\t3,7\n" + "\n".join(body) + "\n")
    (tmp_path / "p.bed").write_text("".join(f"1\t{k * 250_000}\t{k * 250_000}\n" for k in range(19)))
    for k, matrix in enumerate(("matrix", "one.tsv")):
        cli.main(["peaks", "--matrix", at(matrix), "--first", at("p.bed"), "--out", at(f"w{k}"), "--span", "2", "--submatrices", at(f"s{k}")], spark)
    cells = [sorted(map(tuple, spark.read.parquet(at(f"w{k}/cells")).collect())) for k in (0, 1)]
    assert cells[0] == cells[1] and len(cells[0]) == 25
    cli.main(["merge", at("w0"), at("w1"), at("nowhere"), "--out", at("sum")], spark)
    assert {r.passage for r in spark.read.parquet(at("sum/cells")).collect()} == {2 * c[-1] for c in cells[0]}
    cli.main(["predict", "--path", at("sum"), "--out", at("prediction")], spark)
    assert spark.read.text(at("prediction")).count() == 1


def test_small_splits_grow_with_the_files(spark, tmp_path):
    """Splits of a byte do not become as many as the bytes, and together hold every read once."""
    at = str(tmp_path / "b")
    reads = spark.range(12_000).selectExpr("cast(65 AS int) AS flag", "'x' AS c1", "id + 1 AS p1", "'y' AS c2", "id * 7 % 5000 + 1 AS p2", "cast(id % 9 AS int) AS filters")
    bam.write_bam(reads.repartition(3), [("x", 20_000), ("y", 9_000)], at, block_bytes=3000)
    parts = bam.BamReader({"path": at, "splitbytes": "1"}).partitions()
    assert 100 < len(parts) <= bam.SPLITS + 6
    got = bam.read_bam(spark, at, "XF", 1)
    assert got.count() == 12_000 and {tuple(r) for r in got.select("c1", "p1", "c2", "p2", "filters").collect()} == {("x", i + 1, "y", i * 7 % 5000 + 1, i % 9) for i in range(12_000)}


def test_reads_that_do_not_fit_fail(spark, tmp_path):
    for row in ((65, "x", 1 << 40, "x", 1, 0), (1 << 17, "x", 1, "x", 1, 0), (65, "x", None, "x", 1, 0)):
        df = spark.createDataFrame([row], "flag int, c1 string, p1 bigint, c2 string, p2 bigint, filters int")
        with pytest.raises(Exception, match="fit its field|without flag"):
            bam.write_bam(df, [("x", 100)], str(tmp_path / "f"))
