"""Connected components by alternating star operations: every node ends linked to the smallest of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.session import materialize


#: Edges per file.
ROWS = 200_000


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node of its neighbourhood. Edges may come twice."""
    both = _undirected(edges)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root`` (the smallest node of its component) for every node of ``edges(a, b)`` that is not a root.

    Edges with a null end or with equal ends carry nothing and are left out; an empty table gives an empty one. Nodes are of any
    type with an order. The number of rounds grows with the logarithm of the longest path. A node with very many neighbours is a
    hot join key, never one row: its neighbours stay rows, and adaptive execution splits the join. Each round is written to the
    shared folder, so lost executors lose none, in as few files as its rows need.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state
        now = materialize(_small_star(_large_star(now)).coalesce(1 + state[0] // ROWS), "edges")
