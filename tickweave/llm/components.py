"""Connected components of a graph in a table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every larger (large star) or smaller (small star) neighbour of a node to the node's smallest."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    if large:
        linked = both.filter("b > a").join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = both.join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = linked.unionByName(low.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long nodes to (node, label): the smallest node that each can reach. Nodes without a link are left out.

    Every round writes its links to the shared folder; rounds grow with the logarithm of the largest component. A node with many
    links meets one row (its smallest neighbour) in each join; as that side of the join is an aggregate, the links of one node
    meet it in one task. Writing that side each time would let the join be split, but doubles the jobs of a round.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        edges = written(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        before = tuple(now)
