"""The contact matrix: counting, range filters, normalisation. Upper half only: bin1 <= bin2, each pair of bins once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .genome import locate

#: Read filters are numbered from 1; the default leaves out these.
DEFAULT_FILTERS = (1, 2, 3, 4, 6, 7, 8, 9, 10)


def filter_mask(excluded: tuple[int, ...] = DEFAULT_FILTERS) -> int:
    return sum(1 << (f - 1) for f in set(excluded))


def drop_filtered(reads: DataFrame, excluded: tuple[int, ...] = DEFAULT_FILTERS, flag: str = "flag") -> DataFrame:
    """Reads none of whose filter bits is excluded."""
    return reads.where(F.col(flag).bitwiseAND(F.lit(filter_mask(excluded))) == 0)


def count_contacts(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Read pairs, by the global bins of their ends, to (bin1, bin2, raw)."""
    ends = pairs.select(F.least(a, b).alias("bin1"), F.greatest(a, b).alias("bin2")).where("bin1 is not null and bin2 is not null")
    return ends.groupBy("bin1", "bin2").agg(F.count("*").alias("raw"))


def upper_half(contacts: DataFrame) -> DataFrame:
    return contacts.where("bin2 >= bin1")


def bad_bins(*lists: DataFrame) -> DataFrame:
    """Bad bins of several lists as one (bin)."""
    out = lists[0].select("bin")
    for x in lists[1:]:
        out = out.union(x.select("bin"))
    return out.distinct()


def drop_bad(contacts: DataFrame, bad: DataFrame) -> DataFrame:
    """Contacts neither of whose bins is bad. The joins are broadcast where the list is small, at planning or at run time."""
    bad = bad.select("bin")
    out = contacts.join(bad, contacts["bin1"] == bad["bin"], "left_anti")
    return out.join(bad, out["bin2"] == bad["bin"], "left_anti")


def in_window(contacts: DataFrame, window: str | tuple[float, float], genome: DataFrame | None = None) -> DataFrame:
    """'all', 'intra' or 'inter' (by the chromosomes of the two bins), or (low, high): low <= bin2 - bin1 <= high, both ends closed, whatever the chromosomes."""
    if window == "all":
        return contacts
    if window in ("intra", "inter"):
        both = locate(locate(contacts, genome, "bin1", "_c1", "_l1"), genome, "bin2", "_c2", "_l2")
        same = F.col("_c1") == F.col("_c2")
        return both.where(same if window == "intra" else ~same).select(*contacts.columns)
    low, high = window
    return contacts.where((F.col("bin2") - F.col("bin1")).between(low, high))


def normalise(contacts: DataFrame, bias: DataFrame, decay: DataFrame | None = None, genome: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Adds nrm = raw / bias of bin1 / bias of bin2, and / decay of the chromosome and distance where there is one.

    bias: (bin, b); decay: (chrom, dist, d). A contact whose bin has no bias fails the job that reads it; with check=False it is
    left out.
    """
    b = bias.select("bin", "b")
    one, two = b.select(F.col("bin").alias("bin1"), F.col("b").alias("_b1")), b.select(F.col("bin").alias("bin2"), F.col("b").alias("_b2"))
    out = contacts.join(one, "bin1", "left" if check else "inner").join(two, "bin2", "left" if check else "inner")
    nrm = F.col("raw") / F.col("_b1") / F.col("_b2")
    if check:
        lost = F.col("_b1").isNull() | F.col("_b2").isNull()
        nrm = F.when(lost, F.raise_error(F.concat(F.lit("no bias for a bin of contact "), F.col("bin1"), F.lit(", "), F.col("bin2"))).cast("double")).otherwise(nrm)
    out = out.withColumn("nrm", nrm)
    if decay is not None:
        out = locate(locate(out, genome, "bin1", "_c1", "_l1"), genome, "bin2", "_c2", "_l2")
        d = decay.select(F.col("chrom").alias("_c1"), F.col("dist").alias("_dist"), F.col("d").alias("_d"))
        out = out.withColumn("_dist", F.when(F.col("_c1") == F.col("_c2"), F.col("bin2") - F.col("bin1")))
        out = out.join(d, ["_c1", "_dist"], "left").withColumn("nrm", F.col("nrm") / F.coalesce("_d", F.lit(1.0)))
    return out.select(*contacts.columns, "nrm")
