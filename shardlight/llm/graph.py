"""Connected components by alternating stars, with every step a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node in links (a, b), written; component: its smallest node. No links: no rows.

    Each node's neighbours are hung on the smallest of them, larger neighbours first, then smaller ones, until
    nothing changes; the rounds grow with the logarithm of the longest path. Nothing is gathered in one task: the
    smallest neighbour is an aggregate with partial sums, and joins on a node of many links can be split.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        old = edges
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        discard(old, large)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    named = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "labels")
    discard(edges)
    return named
