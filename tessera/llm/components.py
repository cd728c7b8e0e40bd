"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def _written(least: DataFrame) -> DataFrame:
    """As a table: the join with it then shuffles both of its sides plainly, so that the rows of a node with many links are dealt to many tasks."""
    return stored(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _written(down.groupBy("u").agg(F.min("v").alias("m")))
    hooked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    Nodes are longs. Rows with a null end and loops are ignored; an empty table gives an empty
    result. Every step aggregates before it joins, each round's edges are a written table, and
    only a count and a checksum of them reach the driver. The number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null and u != v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        edges = stored(_small_star(_large_star(edges)), "links")
    pairs = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
