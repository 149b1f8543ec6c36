"""Connected components of a large link table, by hooking, pointer jumping and contraction.

Every step is a partially aggregated minimum or an equi-join that can be split when one node is hot; nothing but a
row count's emptiness reaches the driver, and each round is written to the shared folder, so lost executors cost
only the round at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, staged_at


def _flat(parent: DataFrame) -> tuple[DataFrame, str]:
    """Follow hi -> lo to the end, halving the remaining depth each time; with the path of the table."""
    spark, before = parent.sparkSession, None
    while True:
        up = parent.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
        jumped = parent.join(up, F.col("lo") == F.col("_hi"), "left").select(
            "hi", F.coalesce("_lo", "lo").alias("lo"), F.col("_lo").isNotNull().alias("moved")
        )
        jumped, path = staged_at(jumped, "jump")
        if before is not None:
            drop_path(spark, before)
        parent, before = jumped.select("hi", "lo"), path
        if jumped.where("moved").isEmpty():
            return parent, path


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node of a link, the smallest node it reaches. Self-links and nulls say nothing."""
    spark = links.sparkSession
    links, links_at = staged_at(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct(),
        "links",
    )
    whole = None
    while not links.isEmpty():
        parent, parent_at = _flat(links.groupBy("hi").agg(F.min("lo").alias("lo")))
        root = lambda side: parent.select(F.col("hi").alias(f"_n_{side}"), F.col("lo").alias(f"_r_{side}"))
        ends = links.join(root("hi"), F.col("hi") == F.col("_n_hi"), "left").join(root("lo"), F.col("lo") == F.col("_n_lo"), "left")
        ends = ends.select(F.coalesce("_r_hi", "hi").alias("x"), F.coalesce("_r_lo", "lo").alias("y")).where("x != y")
        done = links_at
        links, links_at = staged_at(ends.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "links")
        drop_path(spark, done)
        if whole is None:
            whole, whole_at = parent, parent_at
        else:
            up = parent.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
            both = whole.join(up, F.col("lo") == F.col("_hi"), "left").select("hi", F.coalesce("_lo", "lo").alias("lo")).unionByName(parent)
            done = [whole_at, parent_at]
            whole, whole_at = staged_at(both, "roots")
            for path in done:
                drop_path(spark, path)
    if whole is None:
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return whole.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        whole.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


class Forest:
    """Union-find over the rows of one batch: links in, a star to each set's smallest row out."""

    def __init__(self, n: int):
        import numpy as np

        self.np, self.parent = np, np.arange(n)

    def link(self, i, j) -> None:
        np, p = self.np, self.parent
        while len(i):
            ri, rj = p[i], p[j]
            apart = ri != rj
            if not apart.any():
                return
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(p, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = p[p]
                if (up == p).all():
                    break
                p[:] = up

    def edges(self):
        rows = self.np.nonzero(self.parent != self.np.arange(len(self.parent)))[0]
        return rows, self.parent[rows]
