"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise import shared


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node in ``links`` (a, b).

    Each round takes over the smallest label among the neighbours and then the label of that label, so that paths halve.
    Rounds are cut by a table in the shared folder; the driver sees only how many labels changed. Links with a null end
    are left out, repeated links and loops do no harm, and without links there are no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = shared.settle(both.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    labels = shared.settle(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        nearer = shared.settle(nearer, "labels")
        ends = nearer.select(F.col("node").alias("component"), F.col("component").alias("end"))
        jumped = nearer.join(ends, "component").select("node", "was", F.col("end").alias("component"))
        jumped = shared.settle(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("was != component").isEmpty():
            return labels
