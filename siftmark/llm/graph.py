"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import checkpointed


def _contracted(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    pairs = large.join(low, "a")
    return pairs.select("b", "m").where("b <> m").union(low.select("a", "m")).distinct().toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Edges stay in Spark; each round is written to the shared folder, and the driver sees two sums.
    Loops, repeated edges and edges with a null end are no edges.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = checkpointed(clean, "links"), None
    while True:
        links = checkpointed(_contracted(links), "links")
        now = links.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
