"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm._common import told


def _links(edges: DataFrame) -> tuple:
    """The written links with their state, a count and a checksum."""
    return told(edges, "links", F.count(F.lit(1)).alias("links"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("checksum"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) longs, any direction. Returns (node, component): for every node with a link to another its smallest
    reachable node. Self links, repeated links and nulls are dropped; no links give an empty result.

    Each round is written to the shared folder, so a lost executor never leads back beyond the last round; only a count and a
    checksum come to the driver. Minima are taken with partial aggregation, so hubs cost no large group.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, state = _links(edges)
    while state.links:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        before = state
        edges, state = _links(small)
        if state == before:
            break
    # a fixed point is a set of stars whose centres are the smallest nodes
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
