"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm import storage


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(low, "a").filter("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small(e: DataFrame) -> DataFrame:
    # every edge as (larger, smaller); the smallest neighbour takes the node and its other smaller neighbours
    down = e.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    low = down.groupBy("x").agg(F.min("y").alias("m"))
    moved = down.join(low, "x").filter("y <> m").select(F.col("m").alias("a"), F.col("y").alias("b"))
    return moved.unionByName(low.select(F.col("m").alias("a"), F.col("x").alias("b"))).distinct()


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the least node that it reaches.  Any orderable type."""
    e = storage.materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    mark = _mark(e)
    while mark[0]:
        before, e = e, storage.materialize(_small(_large(e)), "cc")
        storage.release(before)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
