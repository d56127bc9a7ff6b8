"""Questions about a graph of edges (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Distinct nodes: of the edges, and of ``vertices`` (node), some of which may lie on none. Each side is reduced
    before the sides meet."""
    sides = [edges.select(F.col(side).alias("node")) for side in ("src", "dst")]
    sides += [] if vertices is None else [vertices.select("node")]
    return reduce(DataFrame.union, [side.distinct() for side in sides]).where("node is not null").distinct()


def node_count(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    return nodes(edges, vertices).agg(F.count(F.lit(1)).alias("nodes"))


def node_count_reply(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """The count as a reply's text."""
    return node_count(edges, vertices).select(F.col("nodes").cast("string").alias("reply"))
