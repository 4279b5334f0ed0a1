"""Connected components of a graph given as edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of ``edges(a, b)``; the component is its smallest node.

    Every round, each node takes the smallest label among its own and its neighbours', and then the label of that
    label (pointer jumping), so that labels travel twice as far with every round; it ends when none has changed. Only
    the smallest label per node crosses the network, so a node with very many neighbours costs one row per task.
    """
    links = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label")), "labels")
    while True:
        near = (links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        onward = labels.select(F.col("node").alias("_n"), F.col("label").alias("_far"))
        step = step.join(onward, F.col("new") == F.col("_n")).select("node", F.col("label").alias("old"), F.least("new", "_far").alias("label"))
        step = cut_lineage(step, "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
