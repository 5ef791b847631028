"""Connected components of a graph held as a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import staged


def _around(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("least"))


def _settled(edges: DataFrame) -> bool:
    """Whether all are stars: no node has two edges down, or edges down and up."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return nodes.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b): label is the least node of its component.

    Large star: every neighbour above a node is linked to the node's least neighbour. Small star: a node and its
    neighbours below are linked to the least of them. A round is two joins, each of written tables and written itself: so
    a star of very many edges is summed up before it travels, and AQE may split it in a join, behind which no aggregation
    relies on the join's partitioning. Edges never become more. They lead from the greater node down, so once all are
    stars their centres are the labels; that takes about the logarithm of a component's diameter in rounds."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = staged(_around(now), "around")
        large = both.join(around, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        large = staged(large, "large-stars")
        below = staged(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("least")), "below")
        small = large.join(below, F.col("a") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b")
        small = staged(small.filter("a <> b"), "small-stars")
        now = staged(small.distinct(), "edges")
    own = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return own.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
