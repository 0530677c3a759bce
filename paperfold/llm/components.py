"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.session import as_table


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of edges (a, b).

    Every turn ties all neighbours of a node to their smallest one, first the
    larger neighbours, then the smaller; the number of turns grows with the
    logarithm of the graph's width. Each turn is written to the shared folder,
    which also cuts the lineage. Edges to a node in the hands of many others are
    joined by plain shuffles that adaptive execution may split.
    """
    now = as_table(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while before != (before := _state(now)):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _tied(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tied = _tied(large)
        small = (
            tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(tied.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = as_table(small, "stars")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _tied(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(smallest, "u").withColumn("m", F.least("u", "least"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
