"""Connected components of an edge table by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, table


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component): for each id in edges (a, b) the smallest id reachable, itself included.

    Each round takes the smallest label among neighbours and then the label of that label, so chains shrink by half.
    Every round's labels are written to the shared folder: no lineage grows, and a lost executor repeats one round.
    """
    both = table(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = table(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        lower = table(spark, lower, "labels")
        jump = lower.select(F.col("id").alias("to"), F.col("component").alias("further"))
        new = table(spark, lower.join(jump, lower["component"] == jump["to"]).select("id", "before", F.least("component", "further").alias("component")), "labels")
        drop(spark, lower)
        drop(spark, labels)
        labels = new
        if new.where("component <> before").isEmpty():
            drop(spark, both)
            out = new.select("id", "component")
            out.wayfold_path = new.wayfold_path
            return out
