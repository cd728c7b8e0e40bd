"""Vectors and matrices made without input."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def random_vector(spark: SparkSession, n: int, bound: float = 1.0, seed: int = 0, integer: bool = False) -> Vector:
    """Uniform in [0, bound); whole numbers from 0 to bound with integer."""
    u = uniform(F.col("id"), seed)
    v = F.floor(u * (bound + 1)).cast("double") if integer else u * F.lit(float(bound))
    return Vector(spark.range(n).select(F.col("id").alias("i"), v.alias("v")), n)


def random_sparse(spark: SparkSession, n: int, rate: float, bound: float = 1.0, zero: float = 0.0, seed: int = 0) -> Vector:
    """Each index is stored with probability rate."""
    chosen = random_vector(spark, n, bound, seed)
    return Vector(chosen.df.filter(uniform(F.col("i"), seed + 1) < rate), n, zero, False)


#: From this density on every place is drawn by itself.
MANY = 1 / 16


def random_matrix(spark: SparkSession, n: int, m: int, density: float, seed: int = 0) -> Matrix:
    """Each place is stored with probability density, with a value uniform in [0, 1).

    Where few places are, the gaps between them are drawn in place of the places (geometric, in
    each row, ten standard deviations more than a row has on average), so that the work is that of
    the entries.
    """
    if density >= MANY:
        place = F.col("id")
        chosen = spark.range(n * m).filter(uniform(place, seed) < density)
        return Matrix(chosen.select(F.floor(place / m).cast("long").alias("i"), (place % m).alias("j"), uniform(place, seed + 1).alias("v")), n, m)
    if density <= 0:
        return Matrix.empty(spark, n, m)
    most = min(m, int(density * m + 10 * math.sqrt(density * m) + 20))
    drawn = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    at = F.struct("i", "k")
    gap = 1 + F.floor(F.log(1 - uniform(at, seed)) / math.log1p(-density))
    places = drawn.select("i", "k", F.least(gap, F.lit(m + 1)).cast("long").alias("gap")).withColumn("j", F.sum("gap").over(Window.partitionBy("i").orderBy("k")) - 1)
    return Matrix(places.filter(F.col("j") < m).select("i", "j", uniform(at, seed + 1).alias("v")), n, m)
