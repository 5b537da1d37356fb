"""Connected components of a link table, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of ``links`` (a, b), component its smallest reachable node.

    Rounds of large star and small star: every node's larger neighbours, then
    its smaller ones, are tied to the smallest node around it, until each
    node is tied to its component's smallest alone. A round groups by node
    with partial aggregation and writes its links, so no component or
    neighbourhood is ever gathered in one task or the driver.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                        .where("u < v").distinct(), "links")
    while True:
        both = edges.union(edges.select("u", "v").toDF("v", "u"))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v")
        large = large.distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v")
                 .union(least.select("v", F.col("m").alias("u"))).distinct())
        after = materialise(small, "links")
        mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark(after) == mark(edges):
            break
        edges = after
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        edges.select("u", "u").distinct())
