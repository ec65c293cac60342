"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of ``edges`` (a, b); the component is its smallest node.

    Edges stay distributed; a node's smallest neighbour is found with map-side combine. The steps end
    when a round changes no edge, after about the logarithm of the longest path.
    """
    tree = edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    tree, seen = cut_lineage(tree.distinct()), None
    while True:
        state = tree.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == seen or not state[0]:
            return tree.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                tree.select(F.col("u").alias("node"), F.col("u").alias("component"))
            ).distinct()
        seen = state
        # Large star: the larger neighbours of a node move to its smallest neighbour.
        both = tree.unionByName(tree.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: the smaller neighbours of a node, and the node, move to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(least, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        tree = cut_lineage(moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
