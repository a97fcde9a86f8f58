"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkwarden.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component_id) of every node of ``edges(a, b)``; the component's id is its smallest node.

    Each half round is one minimum per node, combined before its shuffle, and one join of the links with it, which
    adaptive execution splits at a node with many links. Only a count and a check sum reach the driver. Links with a
    null end or from a node to itself are left out. A graph that is not settled after ``rounds`` raises an error.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = _both_ways(edges)
        # Written first, so that the join with it can be split at a node with many links.
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        # Every smaller neighbour and the node itself point to the smallest one.
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.where("a <> b").distinct())
        now = _state(edges)
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
            )
        before = now
    raise RuntimeError(f"components not settled after {rounds} rounds")
