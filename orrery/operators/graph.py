"""Connected components and the families they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.sources.scratch import written

def _written(df: DataFrame) -> DataFrame:
    return written(df, "graph")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches, by minimum labels and pointer jumping; no round goes through the driver."""
    both = _written(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).union(edges.select(right, left)).distinct())
    labels = _written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near.hint("merge"), "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        far = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        labels = _written(low.join(far.hint("merge"), "low", "left").select("node", F.least("low", "far").alias("component"), "old"))
        if labels.where("component < old").isEmpty():
            return labels.select("node", "component")


def families(labels: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(family, size) of every component and of every node without one; the family's name digests its sorted members."""
    whole = nodes.select(F.col(key).alias("node")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = whole.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("m"))
    return members.select(F.sha2(F.array_join("m", ","), 256).alias("family"), F.size("m").cast("long").alias("size"))
