"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import forget, join_hot, save

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Hang neighbours on the least of a node's neighbourhood: those above the node (large), or those below it and the node itself."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    hung = join_hot(both, least, "a", ["m"], F.col("n"), 2 * total, "b")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _state(edges: DataFrame) -> tuple:
    h: Column = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From undirected edges (a, b): each node's component, named by its least node (node, component). Loops and
    repeated edges don't matter; an edge with a null end is none. Every round is cut off in the shared folder."""
    now = save(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _state(now)
    for _ in range(MOST_ROUNDS):
        before, now = now, save(_star(_star(now, True, seen[0]), False, seen[0]))
        forget(before)
        state = _state(now)
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
    raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
