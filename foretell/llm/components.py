"""Connected components of a graph too large for one task or for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import checkpointed, join_unique


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang every larger neighbour of a node on the least node that the node sees."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_unique(around, least, ["u"], 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = join_unique(down, least, ["u"], 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; root is the component's least node.

    Alternating large-star and small-star rounds: each round is two grouped
    minima, added up before they are shuffled, and joined back; the minima of
    hubs are broadcast, so that a hub's neighbours stay where they are. Rounds
    end when the edge set is a star forest; the driver sees two numbers a round.
    Self loops, repeated and reversed edges are allowed; nulls are not nodes.
    """
    clean = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    current = checkpointed(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(current)
    while state[0]:
        starred = checkpointed(_large_star(current, state[0]))
        current = checkpointed(_small_star(starred, 2 * state[0]))
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
