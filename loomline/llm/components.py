"""Connected components of links in tables, by large-star and small-star steps; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stage


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    low = F.least("a", "m")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), low.alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Edges run from the larger (a) to the smaller (b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): the least node that it reaches. Links may repeat or be loops."""
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = None
    while True:
        before, edges = edges, stage(_small(_large(edges)), "stars")
        forget(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stage(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
