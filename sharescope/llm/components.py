"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has a link. `links` are pairs (a, b), in any order.

    Large-star and small-star rounds (Kiveris et al., 2014): each node hangs its larger, then its smaller neighbours on
    the smallest of them. A node's neighbours are only reduced to their minimum, before the shuffle where they can be, and never
    gathered. Rounds are stored, so lineage stays short; they end when nothing changes, after about the logarithm of the longest
    chain.
    """
    edges = store(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        after = store(small.select("e.a", "e.b").filter("a <> b").distinct())
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = after
