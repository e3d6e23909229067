"""Waffles on disk: Parquet for work, text forms for other tools."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import python_rounded
from ..operators.waffle import dense, merge_cells, merge_heads


CELLS = "grp string, x int, y int, sum_raw double, sqr_raw double, sum_nrm double, sqr_nrm double, passage bigint"
HEAD = "grp string, resolution int, size int, counter bigint"


def write_waffle(cells: DataFrame, head: DataFrame, path: str) -> None:
    cells.write.parquet(f"{path}/cells")
    head.write.parquet(f"{path}/head")


def read_waffle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/head")


def _there(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """A folder as Spark names it in results, and its number of Parquet files; None if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    return files.makeQualified(at).toString(), sum(f.getPath().getName().endswith(".parquet") for f in files.listStatus(at))


def merge_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The sum of many waffles, and the paths that could not be read. The first must be readable.

    Whatever the number of paths, two jobs look at their files: one at how all of them begin and end, and one at whether heads
    hold what heads do. What is whole is then read at once.
    """
    listed = {p: [_there(spark, f"{p}/cells"), _there(spark, f"{p}/head")] for p in dict.fromkeys(paths)}
    number = {x[0]: x[1] for both in listed.values() for x in both if x}
    parts = {p: [x[0] if x else None for x in both] for p, both in listed.items()}
    there = [x for both in parts.values() if None not in both for x in both]
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    good: set[str] = set()
    if there:
        # a file that can't be read to its end gives no row
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").load(there)
        mark = lambda at: F.expr(f"substring(content, {at}, 4)") == F.lit(b"PAR1")
        state = files.select(folder("path").alias("folder"), (mark(1) & mark(-4) & (F.col("length") >= 12)).alias("ok")).groupBy("folder").agg(F.sum(F.col("ok").cast("int")).alias("n"))
        good = {r.folder for r in state.collect() if r.n == number.get(r.folder)}
    if heads := [both[1] for both in parts.values() if None not in both and both[1] in good]:
        rows = spark.read.schema(HEAD).parquet(*heads).select(folder("_metadata.file_path").alias("folder"), F.col("counter").isNull().alias("other"))
        strange = {plain_path(r.folder) for r in rows.groupBy("folder").agg(F.bool_or("other").alias("other")).collect() if r.other}
        good -= {h for h in heads if plain_path(h) in strange}
    sound = [p for p in paths if all(x in good for x in parts[p])]
    missed = [p for p in paths if p not in sound]
    if not paths or paths[0] in missed:
        raise FileNotFoundError(f"no waffle in {paths[:1]}")
    cells = spark.read.schema(CELLS).parquet(*[f"{p}/cells" for p in sound])
    head = spark.read.schema(HEAD).parquet(*[f"{p}/head" for p in sound])
    return merge_cells(cells), merge_heads(head), missed


def plain_path(uri: str) -> str:
    """A file's path without scheme and doubled slashes, as file:/x and file:///x are one."""
    return "/" + uri.split(":", 1)[-1].lstrip("/") if uri.startswith("file:") else uri


def write_split(cells: DataFrame, head: DataFrame, path: str, run: str | None = None) -> str:
    """A folder for each group of each run, run=.../attempt=.../grp=...; gives the run's name. Runs add up on reading, and a run that is written again under
    its name takes the place of what it wrote before.

    Each attempt writes a folder of its own, and counts from when the run's entry in the manifest names it; a failed one never does.
    """
    spark, run, attempt = cells.sparkSession, run or uuid.uuid4().hex, uuid.uuid4().hex
    for name, df in (("cells", cells), ("head", head)):
        df.write.partitionBy("grp").parquet(f"{path}/{name}/run={run}/attempt={attempt}")
    spark.createDataFrame([(run, attempt)], "run string, attempt string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{run}")
    return run


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    runs = spark.read.schema("run string, attempt string").json(f"{path}/manifest/*").collect()  # a row for each run
    schema = lambda df: df.withColumn("grp", F.coalesce(F.col("grp").cast("string"), F.lit("")))

    def part(name: str, columns: str) -> DataFrame:
        rows = spark.read.schema(f"{columns}, run string, attempt string").parquet(f"{path}/{name}")
        return schema(rows.where(F.col("attempt").isin([r.attempt for r in runs])).drop("run", "attempt"))

    return merge_cells(part("cells", CELLS)), merge_heads(part("head", HEAD))


def text_form(cells: DataFrame, head: DataFrame) -> DataFrame:
    """(grp, header, sums, squares): a group's '>' line and its two dense lines, x slowest, rounded to 3 places."""
    d = dense(cells, head)
    line = lambda c: F.concat_ws("\t", F.transform(F.array_sort(F.collect_list(F.struct("x", "y", F.col(c).alias("v")))), lambda s: s["v"]))
    d = d.withColumn("sums", python_rounded("sum_nrm")).withColumn("squares", python_rounded("sqr_nrm"))
    lines = d.groupBy("grp", "resolution", "size", "counter").agg(line("sums").alias("sums"), line("squares").alias("squares"))
    return lines.select("grp", F.concat(F.lit(">"), F.concat_ws("\t", "grp", "resolution", "size", "counter")).alias("header"), "sums", "squares")


#: The four lines that open the text form.
TEXT_HEAD = ("# Waffle-peak output file", "# >group name\tresolution\tsub-matrix size\tnumber of submatrices", "# Sum of normalized interactions", "# Sum of square normalized interactions")


def write_text(cells: DataFrame, head: DataFrame, path: str) -> None:
    """One text file in a folder. Waffles are small sums, a few lines for each group, whatever the matrix."""
    spark = cells.sparkSession
    rows = text_form(cells, head).select(F.concat_ws("\n", "header", "sums", "squares").alias("value"), F.concat(F.lit("1"), "grp").alias("o"))
    first = spark.createDataFrame([("\n".join(TEXT_HEAD), "0")], "value string, o string")
    first.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)


def read_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells and heads from the text form; observation counts are not in it and come as null, zero cells are left out."""
    parts = spark.read.option("lineSep", "\n>").text(path).where(~F.col("value").startswith("#"))
    w = F.split("value", "\n")
    h = F.split(w[0], "\t")
    rows = parts.select(h[0].alias("grp"), h[1].cast("int").alias("resolution"), h[2].cast("int").alias("size"), h[3].cast("bigint").alias("counter"), F.split(w[1], "\t").alias("s"), F.split(w[2], "\t").alias("q"))
    cells = rows.select("grp", "size", F.posexplode(F.arrays_zip("s", "q")).alias("at", "v"))
    cells = cells.select("grp", F.expr("cast(at div size as int)").alias("x"), (F.col("at") % F.col("size")).cast("int").alias("y"), F.lit(0.0).alias("sum_raw"), F.lit(0.0).alias("sqr_raw"), F.col("v.s").cast("double").alias("sum_nrm"), F.col("v.q").cast("double").alias("sqr_nrm"), F.lit(None).cast("bigint").alias("passage"))
    return cells.where("sum_nrm <> 0 or sqr_nrm <> 0"), rows.select("grp", "resolution", "size", "counter")


def write_submatrices(rows: DataFrame, path: str) -> None:
    """All matched cells as nine tab-separated columns."""
    rows.withColumn("nrm", python_rounded("nrm")).write.csv(path, sep="\t", emptyValue="")


def write_keyed(rows: DataFrame, path: str) -> None:
    """Matched cells by pair: label, cell number, value; gzip. Every row has its label."""
    rows.withColumn("nrm", python_rounded("nrm")).write.option("compression", "gzip").csv(path, sep="\t", emptyValue="")


def write_prediction(predicted: DataFrame, path: str) -> None:
    predicted.select("grp", F.col("spear").cast("string"), F.col("pval").cast("string"), F.col("center").cast("string"), F.initcap(F.col("test").cast("string"))).write.csv(path, sep="\t", emptyValue="")
