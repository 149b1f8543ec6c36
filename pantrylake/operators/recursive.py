"""Recursive operators over edge tables: expansion of a DAG with multiplied quantities, and tree closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import cut

DEPTH = 4


def expand(roots: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, node, quantity, level): all nodes under each root, quantities multiplied along the way.

    roots: (root, node, quantity); edges: (parent, child, factor). One join for each level, at most `depth`.
    """
    level = roots.select("root", "node", F.col("quantity").cast("double").alias("quantity"), F.lit(0).alias("level"))
    out = level
    step = edges.select(F.col("parent").alias("node"), "child", "factor")
    for k in range(1, depth + 1):
        level = level.join(step, "node").select("root", F.col("child").alias("node"), (F.col("quantity") * F.col("factor")).alias("quantity"), F.lit(k).alias("level"))
        out = out.unionByName(level)
    return out


def closure(tree: DataFrame, start: Column) -> DataFrame:
    """(node, level): the root above each started node and all nodes below it, each at its least level.

    tree: (node, parent), parent null at a root. A level is one join, and its rows are written before the next; nodes
    met before are not followed again, so a cycle ends. There is no limit of depth.
    """
    edges = tree.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    up = cut(tree.where(start).select("node", "parent").distinct())
    seen, roots = up.select("node"), up.where("parent IS NULL").select("node")
    while True:
        up = up.where("parent IS NOT NULL").join(edges, F.col("parent") == F.col("_n")).select(F.col("_n").alias("node"), F.col("_p").alias("parent")).distinct()
        up = cut(up.join(seen, "node", "left_anti"))
        if up.isEmpty():
            break
        seen, roots = cut(seen.unionByName(up.select("node"))), cut(roots.unionByName(up.where("parent IS NULL").select("node")))
    level, out = cut(roots.distinct().select("node", F.lit(0).cast("long").alias("level"))), None
    out = level
    while True:
        level = level.join(edges, F.col("node") == F.col("_p")).select(F.col("_n").alias("node"), (F.col("level") + 1).alias("level")).distinct()
        level = cut(level.join(out.select("node"), "node", "left_anti"))
        if level.isEmpty():
            return out
        out = cut(out.unionByName(level))
