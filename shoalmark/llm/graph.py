"""Connected components of an edge table, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_proportion, land

MAX_ROUNDS = 60
#: Edges of a task.
EDGES = 50_000


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (``a, b``) to ``node, root``: the smallest node reachable, for nodes that have an edge to another.

    Alternates two steps until nothing changes: every node's larger neighbours move to its smallest neighbour, then
    all its smaller ones do.  Each step is a grouped minimum and a join, so a node with very many neighbours is split
    like any skewed key; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = land(edges), None
    for _ in range(MAX_ROUNDS):
        state = _state(edges)
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, edges = state, in_proportion(edges, EDGES)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(smallest, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = land(small.unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
