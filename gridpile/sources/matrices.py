"""Matrix text files: a header of chromosomes, resolution and bad bins, then bin1, bin2, raw and normalised counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "bin1 bigint, bin2 bigint, raw bigint, nrm double"


class BadHeader(ValueError):
    pass


@dataclass
class Header:
    chroms: list[tuple[str, int]] = field(default_factory=list)
    resolution: int = 0
    bad: list[int] = field(default_factory=list)

    def chroms_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(self.chroms)], "ord int, chrom string, size_bp bigint")

    def bad_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(b,) for b in sorted(set(self.bad))], "bin bigint")


def parse_header(lines: list[str]) -> Header:
    """'# CHROM', '# RESOLUTION' and '# BADCOLS' lines, in that order. Bad bins that are no numbers mean none."""
    out, at = Header(), 0
    while at < len(lines) and len(lines[at].split("\t")) == 3:
        tag, chrom, size = lines[at].split("\t")
        if not tag.startswith("# CHROM"):
            raise BadHeader(f"no chromosome line: {lines[at]!r}")
        out.chroms.append((chrom, int(size)))
        at += 1
    if at + 1 >= len(lines) or not lines[at].startswith("# RESOLUTION") or not lines[at + 1].startswith("# BADCOLS"):
        raise BadHeader("resolution and bad columns must follow the chromosomes")
    out.resolution = int(lines[at].split("\t")[1])
    try:
        out.bad = [int(x) for x in lines[at + 1].split("\t")[1].split(",")]
    except (ValueError, IndexError):
        out.bad = []
    return out


def read_header(spark: SparkSession, path: str, most_lines: int = 100_000) -> Header:
    """The header: the lines at the file's start that begin with '#'. They are its first, so no more than those are fetched."""
    n = 1024
    while True:
        rows = [r.value for r in spark.read.text(path).head(n)]
        body = next((i for i, v in enumerate(rows) if not v.startswith("#")), None)
        if body is not None or len(rows) < n or n >= most_lines:
            return parse_header(rows[:body])
        n *= 8


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(bin1, bin2, raw, nrm) of one file with its header, or of a folder as write_matrix_text leaves it; a line of other columns fails the read."""
    return spark.read.csv(path, sep="\t", comment="#", schema=SCHEMA, mode="FAILFAST", recursiveFileLookup=True)


def check_unique(contacts: DataFrame) -> None:
    """Raises if a pair of bins occurs twice."""
    if contacts.groupBy("bin1", "bin2").count().where("count > 1").limit(1).count():
        raise ValueError("a pair of bins occurs twice in the matrix")


def write_matrix(contacts: DataFrame, path: str, ranges: int | None = None) -> None:
    """Parquet in ranges of bin1, sorted inside, so that readers of some bins skip the rest."""
    dealt = contacts.repartitionByRange(ranges, "bin1") if ranges else contacts.repartitionByRange("bin1")
    dealt.sortWithinPartitions("bin1", "bin2").write.mode("errorifexists").parquet(path)


def write_matrix_text(contacts: DataFrame, header: Header, path: str) -> None:
    """One folder of text: the header is the first part, the sorted matrix the others."""
    spark = contacts.sparkSession
    lines = [f"# CHROM\t{c}\t{n}" for c, n in header.chroms] + [f"# RESOLUTION\t{header.resolution}", f"# BADCOLS\t{','.join(map(str, sorted(set(header.bad))))}"]
    head = spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)
    body = contacts.repartitionByRange("bin1", "bin2").sortWithinPartitions("bin1", "bin2").select(F.concat_ws("\t", "bin1", "bin2", "raw", F.col("nrm").cast("string")).alias("value"))
    head.write.text(path)
    body.write.mode("append").text(path + "/body")
