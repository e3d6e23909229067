"""The contact matrix as tiles, and the squares around pairs of peaks added up tile by tile.

A tile is one row: a square of bins as arrays of places and values. A pair's square touches at most four tiles, so pairs are
listed by the tiles they touch, and a list meets its tile once. The kernel lays the tile out as a small matrix and takes all
squares of a list from it by one array of indices; no row is made for a cell that is not there. Different pairs of one label that
touch a tile are no more than (side + 2 span)^2, so a tile that all pairs fall into has lists of bounded size; labels are dealt
out to SPLITS lists, and to more where a tile has so many pairs that a list would hold more than LIST of them on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of a tile's side, where squares are not wider.
SIDE = 64
#: Lists that the labels of a tile's pairs are dealt out to at least, and pairs of a list on average at most.
SPLITS = 8
LIST = 8192
#: Array cells that the kernel gathers at a time, and that it holds as sums before it hands them on.
GATHER, HOLD = 2_000_000, 4_000_000
SUMS = ("sum_raw", "sqr_raw", "sum_nrm", "sqr_nrm", "passage")
TILES = "tile bigint, at array<int>, raw array<double>, nrm array<double>"


def tile_side(span: int) -> int:
    return max(SIDE, 2 * span + 1)


def _tile(one: Column, two: Column) -> Column:
    """One number for the tile of two tile coordinates of less than 2**31."""
    return F.shiftleft(one.cast("bigint"), 32) + two.cast("bigint")


def tiled(contacts: DataFrame, side: int) -> DataFrame:
    """(tile, at, raw, nrm) of contacts (bin1, bin2, raw, nrm), each an array: a row for each tile with a contact in it.

    at is row * side + column in the tile. Contacts that have the columns of SUMS, as changes of such sums do, give arrays of these.
    """
    names = SUMS if "sqr_nrm" in contacts.columns else ("raw", "nrm")
    values = [(F.col(c) if c in contacts.columns else F.lit(0.0)).cast("double").alias(c) for c in names]
    one, two = (F.expr(f"bin{k} div {side}") for k in (1, 2))
    at = ((F.col("bin1") - one * side) * side + F.col("bin2") - two * side).cast("int").alias("at")
    rows = contacts.select(_tile(one, two).alias("tile"), F.struct(at, *values).alias("v")).groupBy("tile").agg(F.collect_list("v").alias("v"))
    return rows.select("tile", *[F.col(f"v.{c}").alias(c) for c in ("at", *names)])


def listed(pairs: DataFrame, span: int, side: int, labels: bool = False) -> DataFrame:
    """(tile, pairs) of pairs (g1, g2, what): those whose square touches the tile, of one part of the labels in a row.

    Labels may be as many as the pairs, so a tile's parts are counted by its pairs. Few tiles have more than SPLITS of them."""
    near = lambda g: F.sequence(F.expr(f"({g} - {span}) div {side}"), F.expr(f"({g} + {span}) div {side}"))
    touched = pairs.withColumn("t1", F.explode(near("g1"))).withColumn("t2", F.explode(near("g2")))
    touched = touched.withColumn("tile", _tile(F.col("t1"), F.col("t2")))
    many = touched.groupBy("tile").agg(F.ceil(F.count("*") / LIST).alias("parts")).where(F.col("parts") > SPLITS)
    pair = F.struct("g1", "g2", "what", *["what_new"] * labels)
    part = F.pmod(F.xxhash64("what"), F.coalesce("parts", F.lit(SPLITS)))
    return touched.join(many, "tile", "left").groupBy("tile", part.alias("part")).agg(F.collect_list(pair).alias("pairs")).drop("part")


class _Laid:
    """A tile laid out, with room for squares that reach over its edges."""

    def __init__(self, tile: int, at: np.ndarray, values: list[np.ndarray], side: int, span: int):
        self.span, self.width = span, side + 4 * span
        self.top, self.left = (tile >> 32) * side, (tile & 0xFFFFFFFF) * side
        place = (at // side + 2 * span) * self.width + at % side + 2 * span
        self.values = []
        for v in values:
            m = np.zeros(self.width * self.width)
            m[place] = v
            self.values.append(m)
        own = np.arange(2 * span + 1)
        self.square = (own[:, None] * self.width + own).ravel()

    def cells(self, g1: np.ndarray, g2: np.ndarray) -> np.ndarray:
        """Indices of all cells of the squares of some pairs, a row for each pair."""
        corner = (g1 - self.span - self.top + 2 * self.span) * self.width + g2 - self.span - self.left + 2 * self.span
        return corner[:, None] + self.square


def _pairs_of(column: pa.ListArray, i: int) -> tuple:
    rows = column[i].values
    return rows.field("g1").to_numpy(), rows.field("g2").to_numpy(), rows


def summed(lists: DataFrame, tiles: DataFrame, side: int, span: int, one_group: bool = False, with_raw: bool = True) -> DataFrame:
    """(grp, x, y and SUMS): for each label the squares of its pairs added up, cells without a contact left out. A task hands on
    its sums, not the squares. Without with_raw the sums of raw counts are 0."""
    changes = "sqr_nrm" in tiles.columns
    given = [c for c in (SUMS if changes else ("raw", "nrm")) if with_raw or "raw" not in c]
    met = lists.join(tiles, "tile").select("tile", "pairs", "at", *given)
    names_of = [c for c in SUMS if with_raw or "raw" not in c]
    wide = 2 * span + 1
    schema = "grp string, x int, y int, " + ", ".join(f"{c} double" for c in names_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for grp, sums in held.items():
                cell = np.flatnonzero((sums != 0).any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(cell), pa.string()), pa.array((cell // wide).astype(np.int32)), pa.array((cell % wide).astype(np.int32)), *[pa.array(s[cell]) for s in sums]], ["grp", "x", "y", *names_of])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                at, *v = (b.column(k)[i].values.to_numpy() for k in range(2, 3 + len(given)))
                if not changes:  # raw, its square, nrm, its square, 1
                    v = [x for a in v for x in (a, a * a)] + [np.ones(len(at))]
                laid = _Laid(b.column(0)[i].as_py(), at, v, side, span)
                g1, g2, rows = _pairs_of(b.column(1), i)
                if one_group:
                    names, code = [""], np.zeros(len(g1), np.int64)
                else:
                    coded = rows.field("what").dictionary_encode()
                    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                step = max(1, GATHER // (wide * wide))
                for a in range(0, len(order), step):
                    some = order[a : a + step]
                    first = np.flatnonzero(np.diff(code[some], prepend=-1))
                    index = laid.cells(g1[some], g2[some])
                    each = np.stack([np.add.reduceat(m[index], first, axis=0) for m in laid.values])
                    for k, c in enumerate(code[some][first]):
                        grp = names[c]
                        if grp in held:
                            held[grp] += each[:, k]
                        else:
                            held[grp] = each[:, k].copy()
                if len(held) * wide * wide * len(names_of) > HOLD:
                    yield from out()
        yield from out()

    made = met.mapInArrow(run, schema).groupBy("grp", "x", "y").agg(*[F.sum(c).alias(c) for c in names_of])
    return made.select("grp", "x", "y", *[(F.col(c) if c in names_of else F.lit(0.0)).alias(c) for c in SUMS[:-1]], F.col("passage").cast("bigint").alias("passage"))


def matched(lists: DataFrame, tiles: DataFrame, side: int, span: int) -> DataFrame:
    """(what, what_new, bin1, bin2, x, y, raw, nrm): every contact in the square of every pair of the lists, and no other row."""
    met = lists.join(tiles, "tile").select("tile", "pairs", "at", "raw", "nrm")
    wide = 2 * span + 1
    schema = "what string, what_new string, bin1 bigint, bin2 bigint, x int, y int, raw bigint, nrm double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, raw, nrm = (b.column(k)[i].values.to_numpy() for k in range(2, 5))
                laid = _Laid(b.column(0)[i].as_py(), at, [raw, nrm, np.ones(len(at))], side, span)
                g1, g2, rows = _pairs_of(b.column(1), i)
                step = max(1, GATHER // (wide * wide))
                for a in range(0, len(g1), step):
                    index = laid.cells(g1[a : a + step], g2[a : a + step])
                    pair, cell = np.nonzero(laid.values[2][index])
                    place, own = index[pair, cell], pa.array(pair + a)
                    x, y = cell // wide, cell % wide
                    yield pa.RecordBatch.from_arrays(
                        [rows.field("what").take(own), rows.field("what_new").take(own), pa.array(g1[a + pair] - span + x), pa.array(g2[a + pair] - span + y), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)),
                         pa.array(laid.values[0][place].astype(np.int64)), pa.array(laid.values[1][place])],
                        ["what", "what_new", "bin1", "bin2", "x", "y", "raw", "nrm"])

    return met.mapInArrow(run, schema)


# ---------------------------------------------------------------- tiles on disk


def write_tiles(contacts: DataFrame, path: str, side: int = SIDE, buckets: int = 64) -> None:
    """The matrix as tiles in buckets of files, sorted inside: waffles read it without moving a contact."""
    spark = contacts.sparkSession
    name = "gridpile_" + path.rsplit("/", 1)[-1].replace("-", "_") + "_written"
    tiles = tiled(contacts, side).repartition(buckets, "tile")
    tiles.write.mode("error").bucketBy(buckets, "tile").sortBy("tile").option("path", f"{path}/tiles").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE `{name}`")  # the files are not the catalog's
    spark.createDataFrame([(side, buckets)], "side int, buckets int").coalesce(1).write.json(f"{path}/layout")


def open_tiles(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Stored tiles as a table whose buckets Spark knows, and their side."""
    layout = spark.read.schema("side int, buckets int").json(f"{path}/layout").first()
    name = "gridpile_" + path.rsplit("/", 1)[-1].replace("-", "_") + "_tiles"
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(f"CREATE TABLE `{name}` ({TILES}) USING parquet CLUSTERED BY (tile) SORTED BY (tile) INTO {layout.buckets} BUCKETS LOCATION '{path}/tiles'")
    return spark.table(name), layout.side


def stored_waffle(pairs: DataFrame, tiles: DataFrame, side: int, span: int, one_group: bool = False) -> DataFrame:
    """summed over stored tiles: pairs go to the tiles' buckets, and of the files only the range of touched tiles is read."""
    lists = listed(pairs, span, side)
    ends = lists.agg(F.min("tile").alias("low"), F.max("tile").alias("high")).first()
    if ends.low is not None:
        tiles = tiles.where(F.col("tile").between(ends.low, ends.high))
    return summed(lists, tiles, side, span, one_group)
