"""Connected components of an undirected graph, as a distributed union-find.

Alternates the large-star and small-star steps: every node's neighbours are hung on the least of them until each
component is one star around its least node. A node's neighbours never meet in one task: the least one comes from a
partial aggregate, and it is brought back by a join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import dropped, written


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars: each node hangs on one other at most, and on none if others hang on it."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def _hung(around: DataFrame, keep: str) -> DataFrame:
    """around: (u, v) pairs; hangs each v that ``keep`` selects on the least of u and its neighbours."""
    least = around.groupBy(F.col("u").alias("w")).agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = around.join(least, F.col("u") == F.col("w"))
    return written(joined.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the least node reachable, for each node that has an edge.

    Loops and edges with a null end are ignored; repeated edges count once. An empty input gives an empty result.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _hung(both, "v > u")
        # each node and its lesser neighbours; the node itself is hung on the least as well
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = written(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        dropped(edges, large)
        edges = small
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
