"""Registered queries that go through files: each writes what a sink writes, reads it back with a source, and returns those rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import human_bp, rotate
from ..jobs import count_reads, peak_waffles, read_bias, read_decay
from ..operators import contacts as C
from ..operators import genome as G
from ..operators import peaks as K
from ..operators import waffle as W
from ..sources import bam, beds, matrices, sizes, waffles
from ..sources.scratch import new_path
from . import fixture as X
from . import queries as Q
from .oracle import GENOME, MATRIX, PEAKS
from .oracle import SQL as PLAIN

S, R = X.SPAN, X.RESOLUTION
QUERIES: dict[str, Q.Query] = {}


def query(f: Q.Query) -> Q.Query:
    QUERIES[f.__name__] = f
    return f


def _lines(df: DataFrame, name: str, *columns: str, sep: str = "\t") -> str:
    path = new_path(df.sparkSession, name)
    df.select(F.concat_ws(sep, *columns)).write.text(path)
    return path


def _header(spark: SparkSession, d: str) -> matrices.Header:
    chroms = X.genome(spark, d).orderBy("ord").collect()
    return matrices.Header([(r.chrom, r.size_bp) for r in chroms], R, [r.bin for r in X.bad(spark).collect()])


def _matrix_text(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "matrix-text")
    matrices.write_matrix_text(X.contacts(spark, d), _header(spark, d), path)
    return path


@query
def source_matrix_header(spark: SparkSession, d: str) -> DataFrame:
    """Chromosomes, resolution and bad bins of a matrix text."""
    h = matrices.read_header(spark, _matrix_text(spark, d))
    chroms = h.chroms_df(spark).select(F.lit("chrom").alias("tag"), "chrom", F.col("size_bp").alias("n"))
    bad = h.bad_df(spark).select(F.lit("bad"), F.lit(""), "bin")
    return chroms.union(bad).union(spark.createDataFrame([("resolution", "", h.resolution)], "tag string, chrom string, n bigint"))


@query
def source_matrix_text(spark: SparkSession, d: str) -> DataFrame:
    return matrices.read_matrix(spark, _matrix_text(spark, d))


@query
def sink_matrix_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The matrix as sorted Parquet, for each file's range of bins: rows, and whether another file's range overlaps it."""
    path = new_path(spark, "matrix")
    matrices.write_matrix(X.contacts(spark, d), path)
    rows = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    files = rows.groupBy("file").agg(F.min("bin1").alias("low"), F.max("bin1").alias("high"))
    one, two = files.select(F.col("file").alias("f"), "low", "high"), files.toDF("g", "low2", "high2")
    overlaps = one.join(two, F.col("f") < F.col("g")).where("low <= high2 and low2 <= high").agg(F.count("*").alias("overlaps"))
    return rows.agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), F.sum("nrm").alias("nrm")).join(F.broadcast(overlaps))


def _word(name: str) -> F.Column:
    """A name without spaces, as peak lists and FASTA records need it."""
    return F.translate(name, " ", "_")


def _bed(spark: SparkSession, d: str, *columns: str) -> str:
    return _lines(X.raw_peaks(spark, d, "B", True).withColumn("chrom", _word("chrom")), "peaks", *columns, sep=" \t")


@query
def source_peaks_with_feature(spark: SparkSession, d: str) -> DataFrame:
    return beds.read_peaks(spark, _bed(spark, d, "chrom", "p1", "p2", "feature"))


@query
def source_peaks_without_feature(spark: SparkSession, d: str) -> DataFrame:
    return beds.read_peaks(spark, _bed(spark, d, "chrom", "p1", "p2"))


@query
def source_peaks_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Places are features where the list has none of its own."""
    return beds.read_peaks(spark, _bed(spark, d, "chrom", "p1", "p2"), coordinates_as_feature=True)


@query
def source_fasta_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of records of a thousandth of the genome, in lines of 60 bases."""
    bases = F.regexp_replace(F.repeat(F.lit("ACGT"), (F.col("size_bp") / 4000).cast("int")), "(.{1,60})", "$1\n")
    path = new_path(spark, "fasta")
    X.genome(spark, d).orderBy("ord").coalesce(1).select(F.concat(F.lit(">"), _word("chrom"), F.lit(" a record\n"), bases)).write.text(path)
    return sizes.fasta_sizes(spark, path)


def _sam(spark: SparkSession, d: str) -> str:
    """Both lines of every read pair; those of line number 7 carry the filter bit 1024."""
    genome, path = X.genome(spark, d), new_path(spark, "sam")
    genome.orderBy("ord").coalesce(1).select(F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), "size_bp")).write.text(path)
    placed = G.locate(G.locate(X.reads(spark, d), genome, "a", "c1", "l1"), genome, "b", "c2", "l2")
    at = lambda c: (F.col(c) * R + 1).cast("string")
    extra = F.when(F.col("line") == 7, 1024).otherwise(0)
    one = placed.select((65 + extra).cast("string").alias("flag"), "c1", at("l1").alias("p1"), F.when(F.col("c1") == F.col("c2"), "=").otherwise(F.col("c2")).alias("c2"), at("l2").alias("p2"))
    two = placed.select((129 + extra).cast("string"), "c2", at("l2"), "c1", at("l1"))
    body = one.union(two).select(F.concat_ws("\t", F.lit("read"), "flag", "c1", "p1", F.lit("60"), F.lit("50M"), "c2", "p2", F.lit("0"), F.lit("*"), F.lit("*")))
    body.write.mode("append").text(path)
    return path


@query
def source_sam_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sizes.sam_sizes(spark, _sam(spark, d)).select("chrom", "size_bp")


@query
def source_sam_contacts(spark: SparkSession, d: str) -> DataFrame:
    return C.count_contacts(sizes.sam_contacts(spark, _sam(spark, d), X.genome(spark, d), R, 1024))


def _bam(spark: SparkSession, d: str) -> str:
    """The reads as BAM files, both lines of every pair; line number n has filter n in its tag, and those of number 7 flag bit 1024 too."""
    genome, path = X.genome(spark, d), new_path(spark, "bam")
    placed = G.locate(G.locate(X.reads(spark, d), genome, "a", "c1", "l1"), genome, "b", "c2", "l2")
    extra, filters = F.when(F.col("line") == 7, 1024).otherwise(0), F.expr("shiftleft(1, cast(line as int) - 1)")
    at = lambda c: F.col(c) * R + 1
    one = placed.select((65 + extra).alias("flag"), "c1", at("l1").alias("p1"), "c2", at("l2").alias("p2"), filters.alias("filters"))
    two = placed.select((129 + extra).alias("flag"), F.col("c2").alias("c1"), at("l2").alias("p1"), F.col("c1").alias("c2"), at("l1").alias("p2"), filters.alias("filters"))
    bam.write_bam(one.union(two), [(r.chrom, r.size_bp) for r in genome.orderBy("ord").collect()], path)
    return path


@query
def source_bam_sizes(spark: SparkSession, d: str) -> DataFrame:
    return bam.bam_sizes(spark, _bam(spark, d))


@query
def source_bam_contacts(spark: SparkSession, d: str) -> DataFrame:
    """The same as source_sam_contacts, from BAM files in splits of 50 KB."""
    reads = bam.read_bam(spark, _bam(spark, d), split_bytes=50_000)
    return C.count_contacts(sizes.read_ends(reads, X.genome(spark, d), R, 1024))


@query
def source_bam_filters(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of the reads that the default filters leave, by the filter bits in the reads' tag."""
    reads = bam.read_bam(spark, _bam(spark, d), "XF")
    return C.count_contacts(C.drop_filtered(sizes.read_ends(reads, X.genome(spark, d), R), flag="filters"))


def _counted_by_job(spark: SparkSession, d: str, window: str) -> DataFrame:
    bias, out = _lines(X.bias(spark), "bias", "bin", "b"), new_path(spark, "counted")
    count_reads(spark, _bam(spark, d), out, R, bias=bias, bad=[r.bin for r in X.bad(spark).collect()], excluded=(), window=window)
    return matrices.read_matrix(spark, out)


@query
def job_count_reads_intra(spark: SparkSession, d: str) -> DataFrame:
    """Reads from BAM files to a matrix by the counting job, with a window."""
    return _counted_by_job(spark, d, "intra")


@query
def job_count_reads_range(spark: SparkSession, d: str) -> DataFrame:
    return _counted_by_job(spark, d, Q.RANGE)


@query
def job_peak_waffles(spark: SparkSession, d: str) -> DataFrame:
    """The waffle of two lists of peaks over a matrix that is one text file with its header, by the job."""
    folder, single, out = _matrix_text(spark, d), new_path(spark, "matrix-file"), new_path(spark, "waffle")
    lines = spark.read.text(folder).select("value", F.lit(0).alias("part")).unionByName(spark.read.text(folder + "/body").select("value", F.lit(1).alias("part")))
    lines.coalesce(1).sortWithinPartitions("part").select("value").write.text(single)
    beds_of = [_lines(X.raw_peaks(spark, d, side).withColumn("chrom", F.col("chrom")), "peaks", F.translate("chrom", " ", "_"), "p1", "p2") for side in "AB"]
    renamed = new_path(spark, "matrix-file")
    spark.read.text(single).select(F.when(F.col("value").startswith("#"), F.translate("value", " ", "_")).otherwise(F.col("value")).alias("value")).withColumn("value", F.regexp_replace("value", "^#_", "# ")).coalesce(1).write.text(renamed)
    peak_waffles(spark, renamed, *beds_of, out, S)
    cells, head = waffles.read_waffle(spark, out)
    return _counted(cells, head).drop("grp")


@query
def source_bias_and_decay(spark: SparkSession, d: str) -> DataFrame:
    """The matrix normalised by the biases and decays that files hold."""
    bias = read_bias(spark, _lines(X.bias(spark), "bias", "bin", "b"))
    decay = read_decay(spark, _lines(X.decay_table(spark, d), "decay", "chrom", "dist", "d"))
    clean = C.drop_bad(C.upper_half(C.count_contacts(X.reads(spark, d))), X.bad(spark))
    return C.normalise(clean, bias, decay, X.genome(spark, d))


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = Q._usable(spark, d, "A", True), Q._usable(spark, d, "B", True)
    p = Q._pairs(spark, d, features=True)
    return W.waffle(p, X.contacts(spark, d), S), W.waffle_head(K.group_domain(a, b), p, R, S)


def _counted(cells: DataFrame, head: DataFrame) -> DataFrame:
    return Q._shown(cells).join(head.select("grp", "counter"), "grp")


@query
def sink_waffle_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "waffle")
    waffles.write_waffle(*_features(spark, d), path)
    return _counted(*waffles.read_waffle(spark, path))


@query
def sink_waffle_text(spark: SparkSession, d: str) -> DataFrame:
    """Sums to three places, as the text form has them; it holds no observation counts."""
    path = new_path(spark, "waffle-text")
    waffles.write_text(*_features(spark, d), path)
    return _counted(*waffles.read_text(spark, path)).drop("passage")


@query
def sink_waffle_split(spark: SparkSession, d: str) -> DataFrame:
    """Two runs into one folder for each group, which add up on reading; one of them is written twice."""
    path = new_path(spark, "waffle-split")
    for run, (cells, head) in zip("aba", [*zip(*Q._halves(spark, d), strict=True)] * 2, strict=False):
        waffles.write_split(cells, head, path, run)
    return _counted(*waffles.read_split(spark, path))


@query
def source_waffles_missed(spark: SparkSession, d: str) -> DataFrame:
    """Two waffles, a path without files and one of other files: the sum of what can be read, and how many could not."""
    paths = [new_path(spark, "waffle-part") for _ in range(4)]
    for (cells, head), path in zip(zip(*Q._halves(spark, d), strict=True), paths[::3], strict=True):
        waffles.write_waffle(cells, head, path)
    for part in ("cells", "head"):
        spark.range(3).select(F.col("id").cast("string")).write.text(f"{paths[2]}/{part}")
    cells, head, missed = waffles.merge_files(spark, paths)
    return _counted(cells, head).withColumn("missed", F.lit(len(missed)))


@query
def sink_submatrices(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "submatrices")
    hit = W.match_cells(Q._pairs(spark, d, Q.RANGE), X.contacts(spark, d), S)
    waffles.write_submatrices(W.submatrix_rows(hit, X.genome(spark, d)).withColumn("what_new", F.lit("")), path)
    schema = "chrom1 string, local1 bigint, chrom2 string, local2 bigint, x int, y int, nrm double, grp string, what_new string"
    return spark.read.csv(path, sep="\t", schema=schema).fillna("", ["grp", "what_new"])


@query
def sink_keyed_cells(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "keyed")
    waffles.write_keyed(W.keyed_rows(W.match_cells(Q._pairs(spark, d, Q.RANGE, labels=True), X.contacts(spark, d), S), S), path)
    return spark.read.csv(path, sep="\t", schema="what_new string, cell int, nrm double")


@query
def sink_prediction(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "prediction")
    waffles.write_prediction(stats.predict(Q._dense(spark, d, features=True).where("counter > 0")), path)
    rows = spark.read.csv(path, sep="\t", schema="grp string, spear double, pval double, center double, test string")
    return rows.select("grp", F.round(F.when(~F.isnan("spear"), F.col("spear")), 7).alias("spear"), Q._r("center"))


@query
def places_for_readers(spark: SparkSession, d: str) -> DataFrame:
    """Places of the second list in the largest unit that they are a multiple of, and three letters turned by each place."""
    rows = X.raw_peaks(spark, d, "B").select("p1").distinct()
    turned = rotate(F.array(*[F.lit(c) for c in "abc"]), (F.col("p1") % 7 - 3).cast("int"))
    return rows.select("p1", human_bp(F.col("p1")).alias("shown"), F.array_join(turned, "").alias("turned"))


_BED = f"WITH {PEAKS} SELECT replace(chrom, ' ', '_') AS chrom, CAST(pos AS BIGINT) AS p1, CAST(pos AS BIGINT) AS p2, {{}} AS feature FROM rawp WHERE side = 'B'"
_SUMS = PLAIN["waffle_merge"]
_ROUNDED = "CAST(round_even({0} * 1000, 0) AS DOUBLE) / 1000"
_READS = """SELECT least(a, b) AS bin1, greatest(a, b) AS bin2, CAST(count(*) AS BIGINT) AS raw
      FROM (SELECT (l_orderkey * 31 + l_linenumber * 17) % 755 AS a, (l_partkey * 13 + l_suppkey * 7) % 755 AS b FROM lineitem WHERE l_linenumber {}) t GROUP BY 1, 2"""

SQL: dict[str, str] = {
    "source_matrix_header": f"""WITH {GENOME} SELECT 'chrom' AS tag, chrom, size_bp AS n FROM chroms
      UNION ALL SELECT 'bad', '', CAST(range AS BIGINT) FROM range(755) WHERE range % 37 = 0 UNION ALL SELECT 'resolution', '', CAST(10000 AS BIGINT)""",
    "source_matrix_text": PLAIN["contacts_window_all"],
    "sink_matrix_ranges": f"WITH {PEAKS}{MATRIX} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(nrm) AS DOUBLE) AS nrm, CAST(0 AS BIGINT) AS overlaps FROM mat",
    "source_peaks_with_feature": _BED.format("feature"),
    "source_peaks_without_feature": _BED.format("''"),
    "source_peaks_coordinates": _BED.format("replace(chrom, ' ', '_') || ':' || pos || '-' || pos"),
    "source_fasta_sizes": f"WITH {GENOME} SELECT ord, replace(chrom, ' ', '_') AS chrom, CAST(size_bp // 4000 * 4 AS BIGINT) AS size_bp FROM chroms",
    "source_sam_sizes": f"WITH {GENOME} SELECT chrom, size_bp FROM chroms",
    "source_sam_contacts": _READS.format("<> 7"),
    "source_bam_sizes": f"WITH {GENOME} SELECT ord, chrom, size_bp FROM chroms",
    "source_bam_contacts": _READS.format("<> 7"),
    "source_bam_filters": _READS.format("= 5"),
    "job_count_reads_intra": PLAIN["contacts_window_intra"],
    "job_count_reads_range": PLAIN["contacts_window_range"],
    "job_peak_waffles": PLAIN["waffle_intra"],
    "source_bias_and_decay": PLAIN["contacts_normalised"],
    "sink_waffle_parquet": _SUMS,
    "sink_waffle_split": _SUMS,
    "sink_waffle_text": f"WITH w AS ({_SUMS}) SELECT grp, x, y, {_ROUNDED.format('sum_nrm')} AS sum_nrm, {_ROUNDED.format('sqr_nrm')} AS sqr_nrm, counter FROM w",
    "source_waffles_missed": f"WITH w AS ({_SUMS}) SELECT *, CAST(2 AS INT) AS missed FROM w",
    "sink_submatrices": f"WITH w AS ({PLAIN['submatrix_cells']}) SELECT chrom1, local1, chrom2, local2, x, y, {_ROUNDED.format('nrm')} AS nrm, grp, '' AS what_new FROM w",
    "sink_keyed_cells": f"WITH w AS ({PLAIN['submatrix_keyed']}) SELECT what_new, cell, {_ROUNDED.format('nrm')} AS nrm FROM w",
    "sink_prediction": PLAIN["predict_scores"],
    "places_for_readers": f"""WITH {PEAKS} SELECT DISTINCT CAST(pos AS BIGINT) AS p1,
      CASE WHEN pos = 0 THEN '0 b' WHEN pos % 1000000 = 0 THEN (pos // 1000000) || ' Mb' WHEN pos % 1000 = 0 THEN (pos // 1000) || ' kb' ELSE pos || ' b' END AS shown,
      CASE (pos % 7) % 3 WHEN 0 THEN 'abc' WHEN 1 THEN 'cab' ELSE 'bca' END AS turned FROM rawp WHERE side = 'B'""",
}
