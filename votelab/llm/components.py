"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large_star(e: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a < b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node (``b``, the larger end) hands itself and its smaller neighbours to the smallest of them."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(least, "b")
    return (moved.select(F.col("a").alias("b"), F.col("m").alias("a"))
            .unionByName(least.select("b", F.col("m").alias("a"))).where("a < b").distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` of every node of the edges ``(a, b)``: the smallest node reachable. Edge order,
    repeats and loops don't matter; nulls are no nodes. Hub nodes are never gathered: each step is an
    aggregate with a map-side combine and a join on it."""
    e = written(edges.where("a is not null and b is not null and a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        stamp = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if stamp == before or stamp[0] == 0:
            break
        before, last = stamp, e
        e = written(_small_star(_large_star(last)), name)
        dropped(last)
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
