"""python -m gridpile JOB ...: the jobs on files, on the Spark that spark-submit or the environment gives."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import jobs


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridpile")
    sub = top.add_subparsers(dest="job", required=True)
    count = sub.add_parser("count", help="reads (SAM or BAM) to a normalised matrix")
    count.add_argument("--reads", required=True)
    count.add_argument("--out", required=True)
    count.add_argument("--resolution", type=int, required=True)
    count.add_argument("--bias")
    count.add_argument("--decay")
    count.add_argument("--bad", type=_numbers, default=(), help="bad bins, by commas")
    count.add_argument("--window", default="all", help="all, intra, inter or LOW-HIGH in bp")
    count.add_argument("--exclude", type=_numbers, default=jobs.C.DEFAULT_FILTERS, dest="excluded", help="numbers of read filters, by commas")
    count.add_argument("--filter-tag", default="XF")
    peaks = sub.add_parser("peaks", help="waffles around pairs of peaks")
    peaks.add_argument("--matrix", required=True)
    peaks.add_argument("--first", required=True)
    peaks.add_argument("--second")
    peaks.add_argument("--out", required=True)
    peaks.add_argument("--span", type=int, required=True)
    peaks.add_argument("--window", default="intra")
    peaks.add_argument("--max-dist", type=int)
    peaks.add_argument("--coordinates-as-feature", action="store_true")
    peaks.add_argument("--both-are-feature", action="store_true")
    peaks.add_argument("--with-raw", action="store_true")
    peaks.add_argument("--submatrices")
    peaks.add_argument("--text")
    merge = sub.add_parser("merge", help="adds waffles of disjoint runs")
    merge.add_argument("paths", nargs="+")
    merge.add_argument("--out", required=True)
    merge.add_argument("--split", action="store_true")
    merge.add_argument("--run", help="with --split: a run written again under its name replaces itself")
    predict = sub.add_parser("predict", help="rank correlation, centre and verdict of each group")
    predict.add_argument("--path", required=True)
    predict.add_argument("--out", required=True)
    predict.add_argument("--metric", choices=("loop", "normal"), default="loop")
    figures = sub.add_parser("figures", help="the data of one group's figures, a folder of Parquet for each")
    figures.add_argument("--path", required=True)
    figures.add_argument("--out", required=True)
    figures.add_argument("--group", default="")
    figures.add_argument("--metric", choices=("loop", "normal"), default="normal")
    figures.add_argument("--loop", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = vars(parser().parse_args(args))
    job = given.pop("job")
    spark = spark or SparkSession.builder.appName(f"gridpile {job}").getOrCreate()
    if job == "count":
        jobs.count_reads(spark, **given)
    elif job == "peaks":
        jobs.peak_waffles(spark, **given)
    elif job == "merge":
        for path in jobs.merge_waffles(spark, **given):
            print("missing", path)
    elif job == "predict":
        jobs.predict_waffles(spark, **given)
    else:
        out = given.pop("out")
        for name, table in jobs.waffle_figures(spark, **given).items():
            table.write.parquet(f"{out}/{name}")


if __name__ == "__main__":
    main()
