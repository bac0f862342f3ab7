"""Connected components of a graph held in Spark: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 50) -> DataFrame:
    """(node long, component long) for each node of the links (a, b); a component is its smallest node.

    Each round links every node to the smallest node around it, so chains halve, until each node
    is the centre of a star or has one edge to a centre. Minima and degrees are aggregated before
    they are shuffled; joins on a hub are left to Spark's skew handling. Nulls and loops are
    ignored. Raises if the rounds don't suffice, rather than return a part.
    """
    edges = scratch.keep(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(most_rounds):
        if are_stars(edges):
            break
        # large star: a node's larger neighbours go to the smallest of the node and its neighbours
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of those
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.union(least.select("u", "m")).distinct(), "edges")
        scratch.drop(edges)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def are_stars(edges: DataFrame) -> bool:
    """Whether each larger end ``u`` of the edges has one edge and is nowhere the smaller end ``v``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def joined_components(component: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``component`` (node, component) after more links (a, b): only components with a new link are looked at again."""
    of = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = scratch.keep(ends, "new-links")
    merged = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
    merged = scratch.keep(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "merged")
    old = component.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    alone = ends.select(F.col("a").alias("node"), F.col("ca").alias("c")).union(ends.select("b", "cb")).where("node = c").select("node").distinct()
    alone = alone.join(component, "node", "left_anti").join(merged.withColumnsRenamed({"component": "node", "into": "component"}), "node")
    return old.unionByName(alone.select("node", "component"))
