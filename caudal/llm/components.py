"""Connected components by alternating large-star and small-star steps, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of edges (u, v), both longs.

    No neighbourhood is gathered: a node's smallest neighbour is an aggregate, so a node with any number of
    links costs no task more than its rows. Each round ends in a written table.
    """
    now = table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while before != (last := _digest(now)):
        before = last
        both = now.union(now.select("v", "u"))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = table(large.filter("u <> v"), "edges")
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u").select(F.explode(F.array("u", "v")).alias("u"), "low").filter("u <> low").select("u", F.col("low").alias("v")).distinct()
        now = table(small, "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
