"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that each is connected with.

    Every round takes the least label among neighbours and then jumps to that label's own label, so chains halve;
    labels are stored after each round, and rounds go on until none changes. Sums are partial before the shuffle, so
    a node of very many edges is no hot spot. Loops and repeated edges are harmless; no edges, no rows.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = materialize(least.join(jump, "low", "left").select("node", "old", F.least("low", "far").alias("component")))
        discard(labels)
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            discard(both)
            return labels
