"""Connected components of a table of links, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that occurs in links ``(a, b)`` of long keys.

    Each round every node takes the smallest neighbour, follows that node's choice and the links shrink to
    those between different choices, so the number of rounds grows with the log of the size. All steps are
    keyed aggregations and joins of written tables; a node with many links is split by adaptive execution.
    """
    edges = durable(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        choice = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        next_ = choice.select(F.col("a").alias("to"), F.col("to").alias("further"))
        step = durable(choice.join(next_, "to", "left").select("a", F.coalesce("further", "to").alias("to")))
        named = durable(labels.join(step.select(F.col("a").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")))
        at_a = edges.join(step, "a").select(F.col("to").alias("x"), "b")
        moved = at_a.join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        shrunk = durable(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        drop(choice, step, labels, edges)
        edges, labels = shrunk, named
    drop(edges)
    return labels
