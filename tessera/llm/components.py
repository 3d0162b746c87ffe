"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join whose two sides are shuffled
freshly, so that adaptive execution can split a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import rehashed
from tessera.sources.shared import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(rehashed("u").alias("u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(rehashed("a").alias("a"), "m")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: two bigint columns a and b, in any order, repeats and loops allowed. Returns (node, component)
    for every node with an edge to another; component is the smallest node reachable. Null ends are dropped.
    Edges are cut down to stars in a logarithmic number of rounds; `rounds` only guards against a fault and raises."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(edges)
    while seen[0]:
        if not rounds:
            raise RuntimeError("components did not settle")
        after = materialize(_small_star(_large_star(edges)), "edges")
        now = _print(after)
        discard(edges)
        edges, rounds = after, rounds - 1
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
