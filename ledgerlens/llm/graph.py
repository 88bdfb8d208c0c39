"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of edges(a, b) but those that are a component's smallest; nodes are of any
    type that has an order. Every step is a minimum by key and a join, so a node with many edges is pre-aggregated."""
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    now = scratch.keep(edges.select(hi, lo).where("lo < hi").distinct())
    seen = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # minima are written down, so that the joins below read two plain shuffles, whose large partitions Spark can split
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        best = scratch.keep(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(best, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = scratch.keep(small.unionByName(best.select("hi", F.col("m").alias("lo"))).distinct())
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        scratch.drop(now, least, best)
        now = new
        if state == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = state
