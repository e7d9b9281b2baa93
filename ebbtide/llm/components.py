"""Connected components of an undirected link table, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.scratch import forget, saved


def components(links: DataFrame) -> DataFrame:
    """Columns (v, label): every vertex of ``links(a, b)`` with the smallest vertex it reaches.

    Each round gives a vertex the smallest label among itself and its neighbours, then the
    label of that label; rounds are about the logarithm of the longest shortest path. An
    empty link table gives no rows. Only the number of changed rows reaches the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(both.where("a <> b").distinct(), "links")
    labels = saved(edges.groupBy(F.col("a").alias("v")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("v", "b"), "b")
            .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        )
        lowered = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("further"))
        stepped = saved(
            lowered.join(jump, "low", "left")
            .select("v", F.least("low", "further").alias("label"), F.col("label").alias("before")),
            "labels",
        )
        changed = stepped.where("label <> before").limit(1).count()
        forget(labels)
        labels = stepped.select("v", "label")
        if not changed:
            forget(edges)
            return labels
