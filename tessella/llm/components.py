"""Connected components of a distributed edge list by smallest label and label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the smallest node that it reaches. Each round takes the smallest
    label among a node and its neighbours (partial minima before the shuffle, so a hub costs one row for each task)
    and then the label of that label; rounds are staged, and end when no label changes. No edges give no rows."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = stage(edges.union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        low = label.union(near).groupBy("node").agg(F.min("root").alias("root"))
        jump = low.join(label.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        new = stage(jump.select("node", F.least("root", "up").alias("root")), "labels")
        moved = new.join(label.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
        label = new
        if not moved:
            return label
