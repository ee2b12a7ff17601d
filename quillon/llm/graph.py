"""Connected components of a link table by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_materialized, materialize


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    roots = edges.select(F.col("v").alias("x"), F.lit(0).alias("up"))
    nodes = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"))
    odd = nodes.unionByName(roots).groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).where("ups > 1 or (ups = 1 and root = 0)")
    return odd.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; ``component`` is the smallest node reachable.

    Each round hangs larger neighbours on the smallest node around them (large
    star), then every neighbourhood on its smallest node (small star), and
    writes its links to the shared folder. A node with very many links is met
    by partial aggregates and joins that split on skew. Links of a node to
    itself and repeated links add nothing.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    while not _is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        after = materialize(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop_materialized(edges)
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
