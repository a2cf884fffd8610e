"""Connected components of an edge table, by alternating large and small stars.

Edges never leave the executors; the driver sees two numbers a round.  A node
with many neighbours is met by an aggregate (combined before the shuffle) and
by a join whose sides are both dealt for it alone, so that Spark may split it
(the aggregate's own dealing, by the bare node, would bind the join to it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _with_least(edges: DataFrame, node: str, least: DataFrame) -> DataFrame:
    return edges.withColumn("k", F.struct(node)).join(least.select(F.struct(node).alias("k"), "m"), "k").drop("k")


def connected(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(id, label) of every node that has an edge; label is the component's least id.

    ``edges``: columns a and b of one orderable type; direction, repetition and
    loops do not matter."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = scratch.table(edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.table(_with_least(both.where(F.col("v") > F.col("u")), "u", least).select(F.col("v").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = _with_least(large, "a", least)
        small = moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        after = scratch.table(small.distinct())
        scratch.drop(large)
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
