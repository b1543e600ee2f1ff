"""Connected components of links between long ids, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links(a, b)``; root is the smallest id that links lead to.

    Alternating large-star and small-star steps: each round hangs every id on the
    smallest id near it. A star of any size is a key with partial minima, never a
    list in one task; rounds grow with the logarithm of the longest chain.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    before = None
    while True:  # every round but the last has ids hang on smaller ones, so there is a last one
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u hangs on u's smallest
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every smaller neighbour of u hangs on u's smallest, and u as well
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        last, edges = edges, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
