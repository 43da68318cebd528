"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import cut_lineage, join_hot


def _to_smallest(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (a, b), at most `total`, with m, the smallest of a and all its b."""
    smallest = pairs.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
    return join_hot(pairs, smallest, "a", total).select("a", "b", F.least("a", "least").alias("m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _to_smallest(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    linked = _to_smallest(edges, total)
    moved = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(linked.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); the component is its smallest node.

    Alternating large and small stars: each round is two aggregations and two joins by node. A node with very many
    edges is joined by broadcast, so its edges stay spread out, and the rounds grow with the logarithm of the nodes.
    Loops and null ends are left out. An empty table gives an empty table.
    """
    kept = edges.where("a is not null and b is not null and a <> b")
    edges = cut_lineage(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        # stars never have more edges than before
        large = cut_lineage(_large_star(edges, state[0]))
        edges = cut_lineage(_small_star(large, state[0]))
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
