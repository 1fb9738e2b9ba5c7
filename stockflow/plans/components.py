"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.plans.checkpoint import written
from stockflow.plans.skew import join_hot_key


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours (``larger_only``: those with a larger id; else
    the smaller ones and the node itself) tied to the smallest id around the node."""
    both = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).unionByName(edges) if larger_only else edges
    low = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    low = written(low, "stars")
    tied = join_hot_key(both.where("b > a") if larger_only else both, low, "a", "n", both.count())
    tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        tied = tied.unionByName(low.select("a", F.col("m").alias("b")))
    return written(tied.where("a <> b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id reachable from each node of ``edges(a, b)``.

    Rounds of large-star and small-star until nothing changes; their number
    grows with the logarithm of the graph. A node with very many neighbours is
    spread over the tasks (``join_hot_key``), and every round is written to the shared folder.
    Loops and repeated edges are allowed; nodes without another neighbour
    are not returned.
    """
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before, after = None, state(e)
    while after != before:
        before = after
        e = _stars(_stars(e, True), False)
        after = state(e)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
