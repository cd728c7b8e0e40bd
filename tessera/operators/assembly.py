"""Assembly: unordered contributions with repeats, folded into a vector or a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import BINARY, aggregate
from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector


def folded(contributions: DataFrame, keys: list[str], op: str) -> DataFrame:
    """One row a key: values combined by op; with copy the last by seq counts."""
    how: Column = F.max_by("v", "seq") if op == "copy" else aggregate(op, F.col("v"))
    return contributions.groupBy(*keys).agg(how.alias("v"))


def size_of(contributions: DataFrame, key: str = "i") -> int:
    found = contributions.agg(F.max(key)).first()[0]
    return 0 if found is None else found + 1


def assemble_vector(contributions: DataFrame, n: int, op: str = "add", target: Vector | None = None, zero: float = 0.0) -> Vector:
    """contributions (seq, i, v); with a target its values are combined with the folded ones."""
    made = Vector(folded(contributions, ["i"], op), n, zero, False)
    return made if target is None else target.binary(op, made) if target.dense else _onto(target, made, op)


def _onto(target: Vector, made: Vector, op: str) -> Vector:
    x, y = target.df.select("i", F.col("v").alias("x")), made.df.select("i", F.col("v").alias("y"))
    rows = x.join(y, "i", "full")
    both = BINARY[op](F.coalesce("x", F.lit(target.zero)), F.col("y"))
    return Vector(rows.select("i", F.when(F.col("y").isNull(), F.col("x")).otherwise(both).alias("v")), target.n, target.zero, False)


def scatter_onto(target: Vector, contributions: DataFrame, op: str = "add") -> Vector:
    """A dense target with the folded contributions applied where there are some."""
    made = folded(contributions, ["i"], op).withColumnRenamed("v", "y")
    rows = target.df.join(made, "i", "left")
    return Vector(rows.select("i", F.when(F.col("y").isNull(), F.col("v")).otherwise(BINARY[op](F.col("v"), F.col("y"))).alias("v")), target.n)


def assemble_matrix(contributions: DataFrame, n: int, m: int, op: str = "add", target: Matrix | None = None) -> Matrix:
    """contributions (seq, i, j, v); with a target its entries are combined with the folded ones."""
    made = Matrix(folded(contributions, ["i", "j"], op), n, m)
    if target is None:
        return made
    x, y = target.df.withColumnRenamed("v", "x"), made.df.withColumnRenamed("v", "y")
    rows = x.join(y, ["i", "j"], "full")
    both = BINARY[op](F.coalesce("x", F.lit(0.0)), F.col("y"))
    return Matrix(rows.select("i", "j", F.when(F.col("y").isNull(), F.col("x")).otherwise(both).alias("v")), n, m)


def disassemble(x: "Vector | Matrix", *offsets: int) -> DataFrame:
    """The stored values other than 0 as contributions, moved by the offsets."""
    at = dict(zip(("i", "j"), offsets))
    rows = x.df.filter("v != 0")
    return rows.select(*[(F.col(k) + at.get(k, 0)).alias(k) for k in x.df.columns if k != "v"], "v")
