"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component is named by its least node.

    Each round takes the least label among a node's neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of a component's diameter. Every round ends in a checkpoint.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "m").alias("to"))
        roots = labels.select(F.col("node").alias("to"), F.col("component").alias("root"))
        new = cut(lower.join(roots, "to").select("node", "was", F.least("to", "root").alias("component")))
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
