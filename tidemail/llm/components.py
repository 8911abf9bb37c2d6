"""Connected components by alternating large-star and small-star steps.

Each step is a group-by with map-side minimums and a join, so a node with a
very large neighbourhood is split by the skew join and never gathered in one
task.  Every round is written to the shared folder, and rounds end when the
edge set (compared by count and hash sum) stands still.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemail.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of
    ``edges`` (columns a, b; any order, repeats and loops allowed)."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(e)
    while True:
        e = written(_small(_large(e)), "edges")
        now = _state(e)
        if now == seen:
            break
        seen = now
    leaf = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaf.unionByName(leaf.select(F.col("root").alias("node"), "root").distinct())


def _state(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of all."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    up = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return up.where("a <> b").distinct()
