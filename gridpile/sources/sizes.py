"""Chromosome sizes: from tables, FASTA and SAM headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, size_bp) from lines of name and size; their order is the genome's."""
    lines = [r.value.split() for r in spark.read.text(path).collect() if r.value.strip() and not r.value.startswith("#")]
    return spark.createDataFrame([(i, w[0], int(w[1])) for i, w in enumerate(lines)], "ord int, chrom string, size_bp bigint")


def fasta_sizes(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(ord, chrom, size_bp) of a FASTA file's records; the name is the first word after '>'. Every base counts.

    Lines are read in splits, so no record is one value: a record's lines in one split give one sum, and what a split holds
    before its first header is carried to the last header of the splits before. The sums, one for each record and split, are
    put in order in one place. split_bytes: of this read, instead of the session's.
    """
    key, held = "spark.sql.files.maxPartitionBytes", None
    if split_bytes is not None:
        held = spark.conf.get(key)
        spark.conf.set(key, str(split_bytes))
    try:
        lines = spark.read.text(path).withColumn("split", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))).withColumn("at", F.monotonically_increasing_id())

        def run(batches):
            # a task may read several splits, one after the other
            name, size, where, first = None, 0, None, 0
            for b in batches:
                for value, split, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    split = (split["file"], split["start"])
                    if split != where or value.startswith(">"):
                        if where is not None and (name is not None or size):
                            yield _sums(where, first, name, size)
                        name, size, first = (value[1:].split(None, 1) or [""])[0] if value.startswith(">") else None, 0, at
                        where = split
                    if not value.startswith(">"):
                        size += len("".join(value.split()))
            if where is not None and (name is not None or size):
                yield _sums(where, first, name, size)

        rows = lines.select("value", "split", "at").mapInArrow(run, "file string, start bigint, at bigint, chrom string, size bigint").collect()
    finally:
        if held is not None:
            spark.conf.set(key, held)
    found: list[list] = []
    for r in sorted(rows, key=lambda r: (r.file, r.start, r.at)):
        if r.chrom is not None:
            found.append([r.chrom, r.size])
        elif found:
            found[-1][1] += r.size
    return spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(found)], "ord int, chrom string, size_bp bigint")


def _sums(where: tuple[str, int], at: int, name: str | None, size: int):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([where[0]]), pa.array([where[1]], pa.int64()), pa.array([at], pa.int64()), pa.array([name], pa.string()), pa.array([size], pa.int64())], ["file", "start", "at", "chrom", "size"])


def sam_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, size_bp) of the @SQ lines of a SAM file."""
    lines = [r.value for r in spark.read.text(path).where(F.col("value").startswith("@SQ")).collect()]
    found = [dict(x.split(":", 1) for x in v.split("\t")[1:]) for v in lines]
    return spark.createDataFrame([(i, f["SN"], int(f["LN"])) for i, f in enumerate(found)], "ord int, chrom string, size_bp bigint")


def sam_reads(spark: SparkSession, path: str, filter_tag: str = "") -> DataFrame:
    """(flag, c1, p1, mapq, c2, p2, filters) of all lines of a SAM text; filters: the bits in the tag filter_tag, 0 for lines without it."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    w = F.split("value", "\t")
    tag = F.regexp_extract("value", f"\t{filter_tag}:i:(\\d+)", 1) if filter_tag else F.lit("")
    return lines.select(
        w[1].cast("int").alias("flag"), w[2].alias("c1"), w[3].cast("bigint").alias("p1"), w[4].cast("int").alias("mapq"), F.when(w[6] == "=", w[2]).otherwise(w[6]).alias("c2"), w[7].cast("bigint").alias("p2"),
        F.when(tag == "", 0).otherwise(F.try_to_number(tag, F.lit("9999999999"))).cast("int").alias("filters"))


def read_ends(reads: DataFrame, genome: DataFrame, resolution: int, excluded_bits: int = 0) -> DataFrame:
    """(a, b, flag, filters): global bins of both ends of each pair of reads (flag, c1, p1, c2, p2, filters) whose mate is mapped; one
    row of each pair, the first read's. excluded_bits: of flag."""
    reads = reads.where((F.col("flag").bitwiseAND(0x40) != 0) & (F.col("c1") != "*") & (F.col("c2") != "*") & (F.col("flag").bitwiseAND(F.lit(excluded_bits)) == 0))
    s = genome.select("chrom", "bin_start")
    one = reads.join(s.withColumnRenamed("chrom", "c1").withColumnRenamed("bin_start", "s1"), "c1")
    two = one.join(s.withColumnRenamed("chrom", "c2").withColumnRenamed("bin_start", "s2"), "c2")
    place = lambda p, start: F.expr(f"{start} + ({p} - 1) div {int(resolution)}")
    return two.select(place("p1", "s1").alias("a"), place("p2", "s2").alias("b"), "flag", "filters")


def sam_contacts(spark: SparkSession, path: str, genome: DataFrame, resolution: int, excluded_bits: int = 0, filter_tag: str = "") -> DataFrame:
    """read_ends of a SAM text."""
    return read_ends(sam_reads(spark, path, filter_tag), genome, resolution, excluded_bits)
