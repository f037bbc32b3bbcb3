"""Connected components of an edge table by alternating star contraction, and union-find inside a task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root) of each node but the roots: the smallest node of each component is its root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in up]


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every edge then leads from a node to a smaller one nearer its root."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root for every node of edges (a, b: long) that isn't the smallest of its component.

    No task holds a component: each step needs the least neighbour of a node only, found by partial aggregation, and
    joins it back; a node with very many neighbours is split by Spark's skew join. Each step is staged on shared
    storage. Self loops and repeated edges are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        after, to = staged(_stars(now))
        unstage(spark, path)
        now, path = after, to
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
