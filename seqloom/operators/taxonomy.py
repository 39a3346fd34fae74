"""Lowest common ancestors in a taxonomy of (child, parent) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps up a taxonomy; deeper trees are an error in the table.
MOST_DEPTH = 64


def ancestors(tree: DataFrame, nodes: DataFrame, root: int | str) -> DataFrame:
    """``node, ancestor, steps``: each node's way to the root, itself included. ``nodes``: node."""
    now = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    out = now
    for _ in range(MOST_DEPTH):
        now = now.filter(F.col("ancestor") != F.lit(root)).join(tree, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), (F.col("steps") + 1).alias("steps"))
        if now.isEmpty():
            return out
        out = out.unionByName(now)
    raise ValueError(f"the taxonomy is deeper than {MOST_DEPTH}, or has a cycle")


def lca(pairs: DataFrame, tree: DataFrame, root: int | str, none: int | str = 0) -> DataFrame:
    """``key, lca`` of (key, a, b): the lowest node above both; ``a`` itself where ``b`` is ``none``; the root where the
    tree lacks one of them."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    up = ancestors(tree, nodes, root)
    left = up.select(F.col("node").alias("a"), "ancestor", F.col("steps").alias("from_a"))
    right = up.select(F.col("node").alias("b"), "ancestor")
    common = left.join(right, "ancestor").groupBy("a", "b").agg(F.min_by("ancestor", "from_a").alias("found"))
    out = pairs.join(common, ["a", "b"], "left")
    return out.select("key", F.when(F.col("b") == F.lit(none), F.col("a")).otherwise(F.coalesce("found", F.lit(root))).alias("lca"))
