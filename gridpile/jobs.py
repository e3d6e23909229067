"""Whole runs from files to files: counting reads, waffles around peaks, merging, prediction, and the data of figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import contacts as C
from .operators import genome as G
from .operators import pairs as P
from .operators import peaks as K
from .operators import waffle as W
from .sources import bam, beds, matrices, sizes, waffles
from .sources.scratch import stored


def read_bias(spark: SparkSession, path: str) -> DataFrame:
    """(bin, b) from tab-separated lines of a bin and its bias; a bin without a number has none."""
    return spark.read.csv(path, sep="\t", comment="#", schema="bin bigint, b double").where("bin is not null and b is not null")


def read_decay(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, dist, d) from tab-separated lines of a chromosome, a distance in bins and the decay there."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, dist bigint, d double")


def count_reads(
    spark: SparkSession, reads: str, out: str, resolution: int, bias: str | None = None, decay: str | None = None, bad: Sequence[int] = (), excluded: tuple[int, ...] = C.DEFAULT_FILTERS,
    window: str = "all", filter_tag: str = "XF", excluded_bits: int = 0,
) -> matrices.Header:
    """A SAM text, or BAM files (a path that ends in .bam, or a folder of such), to a normalised matrix in text: counted, upper half,
    without bad bins, inside the window, each contact by its bins' bias and decay.

    excluded: numbers of read filters, bits of the whole number that a read holds in filter_tag; reads without the tag were
    filtered by none. excluded_bits are bits of the read's own flag. window: all, intra, inter, or low-high in bp, both ends in.
    Without a bias file every bin's bias is 1. A contact whose bin has none fails the run.
    """
    is_bam = reads.rstrip("/").endswith(".bam") or bam.is_folder_of_bam(reads)
    chroms = bam.bam_sizes(spark, reads) if is_bam else sizes.sam_sizes(spark, reads)
    genome = G.sections(chroms, resolution)
    rows = bam.read_bam(spark, reads, filter_tag) if is_bam else sizes.sam_reads(spark, reads, filter_tag)
    ends = C.drop_filtered(sizes.read_ends(rows, genome, resolution, excluded_bits), excluded, "filters")
    header = matrices.Header([(r.chrom, r.size_bp) for r in chroms.orderBy("ord").collect()], resolution, sorted(set(bad)))
    counted = C.drop_bad(C.upper_half(C.count_contacts(ends)), header.bad_df(spark))
    counted = C.in_window(counted, P.parse_window(window, resolution), genome)
    table = read_bias(spark, bias) if bias else spark.range(G.total_bins(genome)).select(F.col("id").alias("bin"), F.lit(1.0).alias("b"))
    contacts = C.normalise(counted, table, read_decay(spark, decay) if decay else None, genome)
    matrices.write_matrix_text(contacts.select("bin1", "bin2", "raw", "nrm"), header, out)
    return header


def peak_waffles(
    spark: SparkSession, matrix: str, first: str, second: str | None, out: str, span: int, window: str = "intra", coordinates_as_feature: bool = False,
    both_are_feature: bool = False, max_dist: int | None = None, with_raw: bool = False, submatrices: str | None = None, text: str | None = None,
) -> None:
    """Waffles of the pairs of peaks of one list, or of two, over a matrix in text: one file with its header, or a folder as count_reads writes it.

    window: intra, inter, all, or low-high in bp; max_dist in bp. With coordinates_as_feature each place of the first list is a
    group; with both_are_feature all pairs are one. submatrices and text: further outputs, of all matched cells and in text.
    """
    header = matrices.read_header(spark, matrix)
    genome, bad = G.sections(header.chroms_df(spark), header.resolution), header.bad_df(spark)
    usable = lambda path, own: K.drop_all_bad(K.bin_peaks(beds.read_peaks(spark, path, own), genome, header.resolution, span), span, bad)
    a = usable(first, coordinates_as_feature)
    b = a if second is None else usable(second, False)
    if coordinates_as_feature and second is not None:
        b = b.withColumn("feature", F.lit("")).distinct()
    pairs = P.pair_peaks(a, b, span, P.parse_window(window, header.resolution), labels=submatrices is not None, max_dist=None if max_dist is None else max_dist / header.resolution)
    contacts = C.drop_bad(matrices.read_matrix(spark, matrix), bad)
    if submatrices is not None:  # head, waffle and cells are made of the same pairs and contacts
        pairs, contacts = stored(pairs, "pairs"), stored(contacts, "contacts")
    head = W.waffle_head(K.group_domain(a, None if second is None else b, coordinates_as_feature, both_are_feature), pairs, header.resolution, span, both_are_feature)
    waffles.write_waffle(W.waffle(pairs, contacts, span, both_are_feature, with_raw), head, out)
    if submatrices is not None:
        waffles.write_submatrices(W.submatrix_rows(W.match_cells(pairs, contacts, span), genome), submatrices)
    if text is not None:
        waffles.write_text(*waffles.read_waffle(spark, out), text)


def merge_waffles(spark: SparkSession, paths: list[str], out: str, split: bool = False, run: str | None = None) -> list[str]:
    """Adds waffles of disjoint runs, in one table or, with split, in a folder for each group, to what other runs put there; gives
    the paths that could not be read. A run with a name replaces what it wrote before."""
    cells, head, missed = waffles.merge_files(spark, paths)
    if split:
        waffles.write_split(cells, head, out, run)
    else:
        waffles.write_waffle(cells, head, out)
    return missed


def _means(spark: SparkSession, path: str) -> DataFrame:
    return W.mean_over_pairs(W.dense(*waffles.read_waffle(spark, path)))


def predict_waffles(spark: SparkSession, path: str, out: str, metric: str = "loop") -> None:
    """Rank correlation, centre and verdict of every group of a waffle, in text."""
    waffles.write_prediction(stats.predict(_means(spark, path), metric), out)


def waffle_figures(spark: SparkSession, path: str, group: str = "", metric: str = "normal", loop: bool = False) -> dict[str, DataFrame]:
    """What figures of one group show: means, decay, line and bands, Moran's statistics and hot spots, rings. An unknown group is a KeyError."""
    cells, head = waffles.read_waffle(spark, path)
    head = head.where(F.col("grp") == group)
    if head.isEmpty():
        raise KeyError(group)
    mean = W.mean_over_pairs(W.dense(cells.where(F.col("grp") == group), head))
    decay = stats.decay(mean, metric)
    local = stats.moran_local(mean, loop=loop)
    return {"mean": mean, "decay": decay, "fit": stats.deming(decay), "bands": stats.bands(stats.deming(decay)), "moran": stats.moran_global(mean, loop=loop), "local": local, "hot_spots": stats.hot_spots(local), "rings": stats.polar_rings(mean)}
