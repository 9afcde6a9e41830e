"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts


def _towards(edges: DataFrame, larger: bool) -> DataFrame:
    """One star round on edges(u, v) with u > v: every node's neighbours move to the smallest of them and itself."""
    if larger:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    # Map-side minima first: a hub with a third of all links is one partial row a task.
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("w", "m").alias("m"))
    moved = near.join(least, F.col("u") == F.col("w"))
    if larger:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame, cuts: Cuts) -> DataFrame:
    """links(a, b) -> node, component (its smallest node), for every node with a link to another."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cuts.table(edges, "links"), None
    state = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    while True:
        after = edges.agg(state.alias("s")).first().s
        if after == before or not after[0]:
            break
        before = after
        moved = cuts.table(_towards(_towards(edges, True), False), "links")
        cuts.drop(edges)
        edges = moved
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
