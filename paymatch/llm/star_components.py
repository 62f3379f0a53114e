"""Connected components by alternating large-star and small-star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.plans.runtime import stage


def _least(edges: DataFrame) -> DataFrame:
    """The smaller of a node and its smallest neighbour, for each node at the first end of `edges` (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood instead; rows (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these; rows (u, v) with u > v."""
    low = _least(edges)
    return (edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            .where("u > v").distinct())


def star_components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every end of `links` (a, b; longs without nulls): label is the smallest node reachable.

    A node's neighbours are never gathered: their minimum is aggregated and joined back, so a node with very many links is
    only a skewed join key, which Spark splits.  Each round is a written table; the rounds end when a round changes no
    edge, and then every node hangs on its smallest one.  No links give no rows.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while True:
        edges = stage(small_star(stage(large_star(edges))))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
