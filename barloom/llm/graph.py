"""Connected components of a links table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage, unstage


def _mins(edges: DataFrame) -> DataFrame:
    # a minimum per node, combined before the shuffle; joined back, so AQE can split a hub's edges
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_mins(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.unionByName(mins.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (u, v), of one orderable type; root is the smallest node reachable.

    Each round rewires every neighbour of a node to the smallest node it knows; the number of rounds grows
    with the logarithm of a component's diameter. Only a checksum of the edges comes to the driver.
    """
    edges = stage(links.filter("u != v").select("u", "v").distinct())
    seen = None
    while True:
        before, edges = edges, stage(_small_star(_large_star(edges)))
        unstage(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
