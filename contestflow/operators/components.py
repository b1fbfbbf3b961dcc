"""Connected components by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import drop, written


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component: the least node that is reachable over ``links`` (a, b), in either direction.

    Equal links count once and null ends are left out; a link of a node with itself makes the node
    known. Each round takes the least label of all neighbours, pre-aggregated by node, and then
    the label of the label, so chains halve; labels are written once a round, which cuts lineage,
    and only whether any label moved comes to the driver.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    edges = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        least = labels.join(near, "node", "left").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_mid"))
        jump = labels.select(F.col("node").alias("_mid"), F.col("component").alias("_far"))
        moved = written(least.join(jump, "_mid", "left").select("node", F.least("_mid", "_far").alias("component"), (F.least("_mid", "_far") != F.col("_old")).alias("_moved")), "labels")
        drop(labels)
        labels = moved
        if not labels.filter("_moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    drop(edges)
    return labels.select("node", "component")
