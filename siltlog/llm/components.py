"""Connected components by contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node and component (its smallest node) for every end of edges (a, b).

    Each round, every node points to the smallest of itself and its neighbours, and edges are carried over to what their ends
    point to. At least half of the nodes go each round; a star goes in one. Nodes of any degree are reduced by partial
    aggregation. Null ends are ignored; an empty table has no components.
    """
    left = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), f"{label}-0")
    labels = scratch.keep(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")), f"{label}-labels-0")
    done = 0
    while not left.isEmpty():
        done += 1
        both = left.select(F.col("a").alias("node"), F.col("b").alias("next")).union(left.select("b", "a"))
        points = scratch.keep(both.groupBy("node").agg(F.least("node", F.min("next")).alias("to")), f"{label}-to-{done}")
        at_a, at_b = points.toDF("a", "x"), points.toDF("b", "y")
        carried = left.join(at_a, "a").join(at_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
        left = scratch.keep(carried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-{done}")
        labels = scratch.keep(labels.join(points.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"{label}-labels-{done}")
        scratch.drop(f"{label}-{done - 1}", f"{label}-labels-{done - 1}", f"{label}-to-{done}")
    return labels
