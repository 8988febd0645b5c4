"""Connected components as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltline.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) to (node, label) for every node that has an edge.

    The label is the smallest node of the component. Each round a node and the node its label
    names both take the smallest label seen across an edge, then labels are followed one step,
    so long chains shrink by a constant factor per round. Minima are taken before the shuffle:
    a node on a third of the edges sends one value per task. Every round is written to the
    shared checkpoint folder.
    """
    distinct = edges.filter(F.col("src") != F.col("dst"))
    both = cut_lineage(
        distinct.select("src", "dst")
        .unionByName(distinct.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .distinct()
    )
    labels = both.groupBy(F.col("src").alias("node")).agg(
        F.least(F.min("dst"), F.col("node")).alias("label")
    )
    labels = cut_lineage(labels)
    while True:
        seen = (
            both.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("seen"))
        )
        hooked = labels.join(seen, "node").withColumn("seen", F.least("seen", "label"))
        for_roots = hooked.groupBy(F.col("label").alias("node")).agg(
            F.min("seen").alias("root_seen")
        )
        lowered = hooked.join(for_roots, "node", "left").select(
            "node", "label", F.least("seen", "root_seen").alias("lower")
        )
        step = lowered.select(F.col("node").alias("lower"), F.col("lower").alias("next"))
        moved = cut_lineage(
            lowered.join(step, "lower", "left").select(
                "node", "label", F.least("lower", "next").alias("lower")
            )
        )
        settled = moved.filter(F.col("lower") < F.col("label")).isEmpty()
        labels = moved.select("node", F.col("lower").alias("label"))
        if settled:
            return labels
