"""Connected components of an edge table, by least labels and pointer jumping, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for each node of an edge: label is the least node of its component.

    Each round takes the least label among the neighbours, then the label of the label; rounds grow with the
    logarithm of the longest path. Every round is written to the shared folder, so that lost executors cost one round."""
    both = C.stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = C.stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        of = labels.select(F.col("node").alias("to"), F.col("label").alias("on"))
        step = C.stored(moved.join(of, "to").select("node", F.least("to", "on").alias("label"), "was"), "labels")
        C.discard(last)
        last, labels = step, step.select("node", "label")
        if not step.where("label <> was").limit(1).count():
            C.discard(both)
            return labels
