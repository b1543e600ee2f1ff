"""Labelled rows to learn from: never a held-out one, and no more than a stated number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; rows of fold 0 are held out. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> list[tuple[str, int]]:
    """At most ``bound`` pairs of text and label, the first by a hash of the id: the same rows whatever the partitioning.

    Each class gets up to half of the bound. Only the chosen rows' texts are
    looked up. An id with several labels gets the largest.
    """
    marks = labels.where(F.col(target).isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    marks = marks.where(F.col("y").isin(0, 1))
    chosen = [r for y in (0, 1) for r in marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(bound // 2).collect()]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "id long, y int")  # at most `bound` rows
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return sorted(((r.text or "", r.y) for r in rows.collect()))
