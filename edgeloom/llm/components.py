"""Connected components as alternating large and small stars, each round a pair of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); the component is its smallest node.

    A star's centre may have any number of neighbours: minima are combined before they are
    shuffled and the joins back are plain equi-joins, whose large keys Spark splits. Every
    round is written to the shared folder. Nothing but a checksum comes to the driver.
    """
    pairs = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    seen = _state(pairs)
    while seen[0]:
        pairs = cut_lineage(_small_star(_large_star(pairs)))
        now = _state(pairs)
        if now == seen:
            break
        seen = now
    low = pairs.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(low)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select(F.col("lo"), F.col("hi")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = pairs.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
