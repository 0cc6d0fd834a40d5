"""Connected components by propagation of the smallest label, a join and an aggregate per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.runtime import written


def component_labels(edges: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, node, label): the smallest node of each node's component, within its group.

    Each round takes the smallest label among a node's neighbours and then that label's own
    label, so the rounds grow with the logarithm of a component's length. Rounds end when no
    label changes; each is written to the shared folder, which cuts the lineage.
    """
    both = edges.select(group, F.col(a).alias("node"), F.col(b).alias("near")).unionByName(edges.select(group, F.col(b).alias("node"), F.col(a).alias("near")))
    both = written(both.distinct())
    labels = written(both.groupBy(group, "node").agg(F.least("node", F.min("near")).alias("label")))
    while True:
        mine = labels.select(group, F.col("node").alias("near"), F.col("label").alias("_near"))
        best = both.join(mine, [group, "near"]).groupBy(group, "node").agg(F.min("_near").alias("_best"))
        taken = labels.join(best, [group, "node"]).select(group, "node", "label", F.least("label", "_best").alias("_next"))
        # the label of the label, which shortens chains
        onward = labels.select(group, F.col("node").alias("_next"), F.col("label").alias("_onward"))
        new = written(taken.join(onward, [group, "_next"], "left").select(group, "node", "label", F.least("_next", F.coalesce("_onward", "_next")).alias("_new")))
        changed = new.where(F.col("label") != F.col("_new")).limit(1).count()
        labels = new.select(group, "node", F.col("_new").alias("label"))
        if not changed:
            return labels
