"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.sources.storage import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that links reach) for every node of the edges.

    Each round takes the smallest label among a node's neighbours, then the label of that label. Nothing but whether
    a label changed reaches the driver; hubs are aggregated on the map side; each round is a written table. Rows with
    a null end are left out; an empty table gives an empty result.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("node").alias("at"), F.col("l").alias("far"))
        now = written(step.join(jump, F.col("l") == F.col("at"), "left").select("node", "old", F.least("l", F.coalesce("far", "l")).alias("l")), "labels")
        dropped(labels)
        if now.where("l != old").isEmpty():
            dropped(both)
            return now.select("node", F.col("l").alias("component"))
        labels = now.select("node", "l")
        labels._written = now._written
