"""Connected components of a graph given as an edge table, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import discard, stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b; binaries); the component is its smallest node.

    Each round points the edges of every node at its smallest neighbour (larger neighbours first, then
    smaller ones), which halves the length of paths; the edge table is written to the shared folder between
    rounds. A node's edges are only ever aggregated or joined, so a node with very many is no single task's
    list. Raises if the graph has not settled after ``most_rounds`` (which grow with its logarithm).
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now, path = stored(ordered.where("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        large = _star(now, larger=True)
        after, next_path = stored(_star(large, larger=False), "edges")
        discard(edges.sparkSession, path)
        # Settled: every edge joins a component's smallest node and another, which lies on no other edge.
        ends = after.select(F.col("b").alias("n"), F.lit(1).alias("tail"), F.lit(0).alias("head")).unionAll(
            after.select("a", F.lit(0), F.lit(1))
        )
        loose = ends.groupBy("n").agg(F.sum("tail").alias("tails"), F.max("head").alias("heads"))
        if loose.where("tails + heads > 1 and tails > 0").isEmpty():
            roots = after.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return after.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
        now, path = after, next_path
    raise RuntimeError("components have not settled")


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, ...) with the ``m`` of their node u. The key is spelt another way, so that both sides are dealt out
    for the join alone: then a node with very many edges can be split between tasks."""
    key = lambda df: df.withColumn("key", F.concat("u", F.lit(b"")))
    return key(edges).join(key(least).drop("u"), "key").drop("key")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Join each node's neighbours that are larger (or smaller) than it to the smallest node around it."""
    if larger:
        ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        both = edges.select(F.inline(ways))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # A row for each edge at most; repeated ones go with the smaller neighbours, whose rows are dealt out anyway.
        return _met(edges.select(F.col("a").alias("u"), F.col("b").alias("w")), least).select(F.col("m").alias("a"), F.col("w").alias("b"))
    else:
        least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        moved = _met(edges.select(F.col("b").alias("u"), F.col("a").alias("w")), least)
        joined = moved.select("m", F.explode(F.array("w", "u")).alias("w"))
    return joined.where("m <> w").select(F.least("m", "w").alias("a"), F.greatest("m", "w").alias("b")).distinct()
