"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import discard, materialize, view_of


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger (or not larger) neighbours to the smallest node that it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # here a is the centre; small steps see edges as (larger, smaller)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # a centre may have a third of all edges: its rows are narrow, and adaptive execution splits such a partition
    linked = both.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    kept = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b), the component being its smallest node.

    The number of steps grows with the logarithm of the longest path (60 rounds, beyond which it
    raises, are enough for any table); every step is two grouped shuffles of the edges, and no
    more is held for a node than its smallest neighbour. Null, repeated and reversed edges and
    loops may come; an empty table gives an empty result. Other columns are ignored.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        new = materialize(_step(_step(edges, True), False))
        discard(edges)
        edges = new
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components did not settle")
    return view_of(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), edges)
