"""Grids of up to four dimensions in row-major order, their sections, and stencils."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import BINARY, UNARY, aggregate
from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector


@dataclass(frozen=True)
class Grid:
    shape: tuple[int, ...]
    periodic: tuple[bool, ...] = ()

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def strides(self) -> list[int]:
        return [math.prod(self.shape[k + 1 :]) for k in range(len(self.shape))]

    def dims(self, i: Column) -> list[Column]:
        """The coordinates of a linear position."""
        return [(F.floor(i / s) % n).cast("long") for s, n in zip(self.strides(), self.shape)]

    def position(self, at: list[Column]) -> Column:
        found = F.lit(0).cast("long")
        for x, n in zip(at, self.shape):
            found = found * n + x
        return found

    def wraps(self, k: int) -> bool:
        return bool(self.periodic) and self.periodic[k]


@dataclass(frozen=True)
class Stencil:
    """(offsets, weight) pairs."""

    points: tuple[tuple[tuple[int, ...], float], ...]

    @classmethod
    def laplace(cls, dim: int, points: int) -> "Stencil":
        """The Poisson stencils with 3 (1-D), 5 or 9 (2-D), 7, 19 or 27 (3-D) points: each neighbour -1, the centre their number."""
        reach = {(1, 3): 1, (2, 5): 1, (2, 9): 2, (3, 7): 1, (3, 19): 2, (3, 27): 3}[dim, points]
        around = [()]
        for _ in range(dim):
            around = [(*o, d) for o in around for d in (-1, 0, 1)]
        near = [o for o in around if 0 < sum(map(abs, o)) <= reach]
        return cls((*((o, -1.0) for o in near), ((0,) * dim, float(len(near)))))

    def mirrored(self) -> "Stencil":
        """The stencil of the transposed matrix."""
        return Stencil(tuple((tuple(-d for d in o), w) for o, w in self.points))


def neighbours(rows: DataFrame, grid: Grid, stencil: Stencil, keep: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, v): for each position i of rows those it is linked with; outside ones are left out, or wrapped where the grid is periodic. With columns to keep, v is named w."""
    points = F.explode(F.array(*[F.struct(*[F.lit(d).cast("long").alias(f"d{k}") for k, d in enumerate(o)], F.lit(w).alias("w")) for o, w in stencil.points]))
    at = rows.select("i", *keep, *[c.alias(f"x{k}") for k, c in enumerate(grid.dims(F.col("i")))], points.alias("p"))
    inside, moved = F.lit(True), []
    for k, n in enumerate(grid.shape):
        x = F.col(f"x{k}") + F.col(f"p.d{k}")
        if grid.wraps(k):
            x = F.pmod(x, F.lit(n))
        else:
            inside = inside & x.between(0, n - 1)
        moved.append(x)
    return at.filter(inside).select("i", *keep, grid.position(moved).alias("j"), F.col("p.w").alias("w" if keep else "v"))


def stencil_matrix(spark: SparkSession, grid: Grid, stencil: Stencil) -> Matrix:
    rows = neighbours(spark.range(grid.size).select(F.col("id").alias("i")), grid, stencil)
    if any(grid.periodic or ()):
        rows = rows.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return Matrix(rows, grid.size, grid.size)


def poisson(spark: SparkSession, dim: int, points: int, *shape: int) -> Matrix:
    return stencil_matrix(spark, Grid(tuple(shape)), Stencil.laplace(dim, points))


def apply_stencil(x: Vector, grid: Grid, stencil: Stencil) -> Vector:
    """The stencil matrix times x; the matrix is never stored: each value goes to the places whose stencils reach it, where sums are made before and after one shuffle."""
    sent = neighbours(x.df, grid, stencil.mirrored(), ("v",)).select(F.col("j").alias("i"), (F.col("w") * F.col("v")).alias("v"))
    if all(any(o) for o, _ in stencil.points):
        sent = sent.unionByName(x.df.select("i", F.lit(0.0).alias("v")))
    return Vector(sent.groupBy("i").agg(F.sum("v").alias("v")), x.n)


def section(x: Vector, grid: Grid, ranges: list[tuple[int, int, int]]) -> tuple[Vector, Grid]:
    """(values, grid) of a strided section; ranges are (first, end, stride) of each dimension."""
    inside, at, shape = F.lit(True), [], []
    for d, (a, b, s) in zip(grid.dims(F.col("i")), ranges):
        inside = inside & (d >= a) & (d < b) & ((d - a) % s == 0)
        at.append(F.floor((d - a) / s).cast("long"))
        shape.append(max(0, -(-(b - a) // s)))
    small = Grid(tuple(shape))
    return Vector(x.df.filter(inside).select(small.position(at).alias("i"), "v"), small.size), small


def put_section(x: Vector, grid: Grid, ranges: list[tuple[int, int, int]], values: "Vector | float", op: str = "copy") -> Vector:
    """x with op(x, values) in a section; values are a vector over the section's grid or a number."""
    inside, at = F.lit(True), []
    shape = tuple(max(0, -(-(b - a) // s)) for a, b, s in ranges)
    for d, (a, b, s) in zip(grid.dims(F.col("i")), ranges):
        inside = inside & (d >= a) & (d < b) & ((d - a) % s == 0)
        at.append(F.floor((d - a) / s).cast("long"))
    if not isinstance(values, Vector):
        return Vector(x.df.select("i", F.when(inside, BINARY[op](F.col("v"), F.lit(float(values)))).otherwise(F.col("v")).alias("v")), x.n)
    keyed = x.df.select("i", "v", F.when(inside, Grid(shape).position(at)).alias("s"))
    rows = keyed.join(values.df.select(F.col("i").alias("s"), F.col("v").alias("y")), "s", "left")
    return Vector(rows.select("i", F.when(F.col("y").isNull(), F.col("v")).otherwise(BINARY[op](F.col("v"), F.col("y"))).alias("v")), x.n)


def reduce_dim(x: Vector, grid: Grid, dim: int, op: str, before: str = "copy") -> tuple[Vector, Grid]:
    """Values along one dimension by op."""
    rest = Grid(tuple(n for k, n in enumerate(grid.shape) if k != dim))
    at = [c for k, c in enumerate(grid.dims(F.col("i"))) if k != dim]
    rows = x.df.groupBy(rest.position(at).alias("i")).agg(aggregate(op, UNARY[before](F.col("v"))).alias("v"))
    return Vector(rows, rest.size), rest


def transpose_flat(x: Vector, n: int, m: int) -> Vector:
    """The values of an n x m array in the order of its transpose."""
    i = F.col("i")
    return Vector(x.df.select(((i % m) * n + F.floor(i / m)).cast("long").alias("i"), "v"), x.n)
