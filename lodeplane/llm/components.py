"""Connected components by contraction: all state is in tables, nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b); label is the smallest node of the component.

    Each round points every node to its smallest neighbour, shortens those paths once, and merges
    what they join; a component of n nodes takes at most about log(n) rounds. Aggregates combine
    before they shuffle and joins may be split, so a node with many neighbours is no bottleneck.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "parents")
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = cut(parent.join(above, "up").select("node", F.col("top").alias("up")), "parents")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            moved = parent.select(F.col("node").alias("label"), "up")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = cut(labels, "labels")
        edges = edges.join(parent.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        edges = cut(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, label {kind}")
    return labels
