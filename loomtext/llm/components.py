"""Connected components of a graph given as edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import settled


def _least(edges: DataFrame) -> DataFrame:
    """node, m: the least neighbour of each larger end.

    A key is combined before its exchange, and the result is saved, so that both sides of the joins with it come by an exchange of
    their own and the edges of a node of very many neighbours can be split.
    """
    return settled(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b); the root is the least node of its component.

    Edges are held as (larger, smaller) end.  Large stars hang the larger end on the least neighbour of the smaller one, small stars
    hang a node's smaller neighbours and itself on the least of them, until nothing moves; the number of rounds grows with the
    logarithm of the number of nodes.  No task needs all edges of a node.  Loops and repeated edges are allowed and say nothing, nor
    does an edge with a null end; a node that has no other edge is not returned.  No edges: no rows.
    """
    e = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        large = e.join(_least(e), F.col("v") == F.col("node"), "left").select("u", F.coalesce("m", "v").alias("v"))
        large = settled(large)
        hung = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))  # u itself goes with its least neighbour's row
        e = settled(large.join(_least(large), F.col("u") == F.col("node")).select(hung.alias("u"), F.col("m").alias("v")).distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
