"""Connected components over an edge table, by alternating star contraction.

Edges stay in Spark; each round is written to the shared checkpoint folder.
A node with very many edges is only ever aggregated (partial minimum) or met
in a join whose other side has one row for it and is read from a written
table, so that adaptive execution may split the node's edges over tasks; no
neighbour list is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut_lineage(down.groupBy("u").agg(F.min("v").alias("m")))
    tied = down.join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its
    component. ``edges`` has columns u and v; loops are ignored. Rounds go on
    until no edge changes; their number grows with the logarithm of the
    longest path, and nothing caps it. No edges give an empty result."""
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _digest(now)
    while mark[0]:
        now = cut_lineage(_small_star(cut_lineage(_large_star(now))))
        last, mark = mark, _digest(now)
        if mark == last:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
