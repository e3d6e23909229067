"""Connected components of a table of links, by alternating stars; no link or component ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _starred(edges: DataFrame) -> DataFrame:
    """One round over edges (v, u), v > u. First every node ties its larger neighbours to the least of all its neighbours and
    itself, then every node ties itself and its smaller neighbours to the least of those."""
    both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
    large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
    low = large.groupBy("v").agg(F.min("u").alias("m"))
    small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return small.unionByName(low.select("v", F.col("m").alias("u"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that links reach.

    Each round brings nodes nearer to their least neighbour, until every component is a star around its least node; groups of
    copies around one text take two rounds, a chain of n texts about log2(n). Links with a null end and loops count for
    nothing. A node with very many links is one key of pre-aggregated minima and of joins that adaptive execution splits.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = stored(edges, "links")
    while not edges.isEmpty():
        edges = stored(_starred(edges), "links")
        ends = edges.select("v", F.lit(1).alias("out")).unionByName(edges.select(F.col("u").alias("v"), F.lit(0).alias("out")))
        if ends.groupBy("v").agg(F.sum("out").alias("out"), F.max(1 - F.col("out")).alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty():
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select("u", "u").distinct().toDF("node", "component"))
