"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import stage


def components(links: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """node, label for every node of ``links`` (a, b; longs, any direction).

    The label is the smallest node reachable, or the smallest name of a reachable node if ``names``
    (node, name) gives each node one. Names travel with the labels, so nothing is joined by component.

    Each round takes the smallest label among the neighbours and then the label's own label, so
    chains shrink by half a round and more. Minima combine before the shuffle and joins hold one
    row a node on one side, so a node with very many links is split by the adaptive skew join.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    nodes = both.select(F.col("a").alias("node")).distinct()
    if names is None:
        named = nodes.withColumn("name", F.col("node"))
    else:
        named = names.select("node", "name").join(nodes, "node")
    labels = stage(named.select("node", F.struct("name", "node").alias("label")))
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(around, labels.node == around.a).select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("top"), F.col("label").alias("above"))
        moved = stage(best.join(up, F.col("next.node") == F.col("top"), "left").select(
            "node", F.least("next", "above").alias("label"), (F.least("next", "above") < F.col("label")).alias("new")))
        labels = moved.select("node", "label")
        if moved.where("new").isEmpty():
            return labels.select("node", F.col("label.name").alias("label"))
