"""Connected components of links between documents, by large-star and small-star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(near: DataFrame) -> DataFrame:
    """Each (u, v) of `near` with the least of u and its neighbours; a hub's minimum combines before the shuffle."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u")


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node of links (u, v): the least node that can be reached.

    Each step is written to `folder`, which cuts the lineage and lets a lost executor cost one step.
    Steps stop when one changes nothing; their number grows with the logarithm of the nodes.
    """
    spark = links.sparkSession
    edges, before = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None
    step = 0
    while True:
        edges.write.parquet(f"{folder}/edges{step}")
        edges = spark.read.parquet(f"{folder}/edges{step}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 32))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before, step = now, step + 1
        large = _star(_both_ways(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Now every edge runs from u down to v: the least of the smaller neighbours of u is their star.
        small = _star(large)
        edges = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
