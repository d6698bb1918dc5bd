"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def state(e: DataFrame) -> tuple:
    """Number and summed hashes of the edges (u, v); as decimals, which no number of them overflows."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge (a, b); the component is its smallest id.

    Each step is an aggregation and a join on the node, which Spark splits where a node has
    very many edges; each round is written to the shared folder, and only counts and sums
    come to the driver. Self loops, repeated and null edges are dropped.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, "stars")
    before = None
    while (now := state(e)) != before:
        before = now
        if not now[0]:
            break
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        e = cut(small.distinct(), "small-star")
    ends = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(e.select("v", "v").distinct())
