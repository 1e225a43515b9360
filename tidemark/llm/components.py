"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge only, or is the least end of all its edges."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return node.filter("up + down > 1 AND up > 0").isEmpty()


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(a, b): every node of edges (a, b) that is not the least of its component, with that least node.

    Each round links nodes to the least neighbour they know; minima are aggregated before they
    are shuffled, and joined back by a join whose hot nodes adaptive execution splits. Rounds end when
    only stars are left, after about the logarithm of the longest path; edges that are stars need none.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, i = work.write(ordered, f"{name}0"), 0
    while not _stars(now):
        i += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}{i}least")
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.write(large, f"{name}{i}large")
        least = work.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}{i}small")
        small = large.join(least.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = work.write(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}{i}")
        work.drop(f"{name}{i - 1}", f"{name}{i}large", f"{name}{i}least", f"{name}{i}small")
    return now
