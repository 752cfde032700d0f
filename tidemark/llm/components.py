"""Connected components of an edge table by minimum labels and pointer jumping, all in joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, label): each node that has an edge, and the smallest node reachable. No edges: no rows."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = Observation()  # what has changed is counted as the round is written
        near = both.join(labels.select("node", "label"), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("ahead"))
        jumped = hooked.join(ahead, F.col("label") == F.col("at"), "left").select("node", "was", F.least("label", "ahead").alias("label"))
        jumped = materialize(jumped.observe(seen, F.coalesce(F.sum((F.col("label") != F.col("was")).cast("long")), F.lit(0)).alias("changed")))
        discard(labels)
        labels = jumped
        if not seen.get["changed"]:
            discard(both)
            return labels.select("node", "label")
