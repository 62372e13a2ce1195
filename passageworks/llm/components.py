"""Connected components by minimum label with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.common import checkpoint, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; label is the smallest node of its component.

    Every round each node takes the least label among itself and its neighbours, then follows that
    label once more (pointer jumping), so long chains shorten by doubling. Labels are written to the
    checkpoint folder after each round; nothing but counts come to the driver. A label that holds a large
    part of all nodes is followed by broadcast, so no task receives a large component's rows.
    No edges: no rows.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = checkpoint(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")))
        hop = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = checkpoint(spread_join(hooked, hop, "next").select("node", F.col("label").alias("was"), F.least("next", "far").alias("label")))
        changed = after.filter("was <> label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
