"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Large stars and small stars alternate until the links no longer change; every round at least
    halves the longest chain of smaller neighbours in practice, and only sums decide when to stop.
    Links are joined, never gathered at a node, so a node with very many links is split like any
    skewed join key. Links to itself, null ends and repeated links count for nothing.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, seen = cut(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest neighbour
        large = e.join(low, e["v"] == low["w"]).select("u", F.col("m").alias("v")).where("u > v").distinct()
        # small star: the smaller neighbours and the node itself move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = large.join(least, large["u"] == least["w"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u > v").distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            break
        seen = now
    hubs = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
