"""Connected components of a graph given as a table of links, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of a link; label: the least node that it reaches.

    Every round each node takes the least label among its neighbours and then the label of that label, so chains shrink
    by powers of two. Each round is written to the shared folder, which cuts the lineage.
    """
    spark = links.sparkSession
    path = C.scratch(spark, "components")
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = C.written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), f"{path}/links")
    labels = C.written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), f"{path}/0")
    step = 0
    while True:
        step += 1
        by_node = labels.select(F.col("node").alias("other"), F.col("label").alias("via"))
        near = both.join(by_node, "other").groupBy("node").agg(F.min("via").alias("via"))
        hop = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("via", "label")).alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = hop.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("far", "to")).alias("label"))
        new = C.written(new, f"{path}/{step}")
        moved = new.filter("was != label").limit(1).count()
        labels = new.select("node", "label")
        C.delete(spark, f"{path}/{step - 1}")
        C.release(spark)
        if not moved:
            C.delete(spark, f"{path}/links")
            return labels
