"""Connected components of a graph by joins: smallest labels spread over links, with jumps, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.plans.runtime import stage


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every end of `links` (a, b; longs without nulls): label is the smallest node reachable.

    Each round is a written table, so a lost executor costs one round at most.  Labels are replaced by their own labels in
    each round, so that long chains shrink quickly.  No links give no rows.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")))
        spread = stage(labels.join(near.withColumnRenamed("a", "node"), "node")
                       .select("node", F.col("label").alias("before"), F.least("label", "near").alias("label")))
        jumped = stage(spread.join(spread.select(F.col("node").alias("via"), F.col("label").alias("far")), F.col("label") == F.col("via"))
                       .select("node", "before", F.least("label", "far").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("label <> before").isEmpty():
            return labels
