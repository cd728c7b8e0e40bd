"""Arithmetic notation: sums of scaled vectors, matrices and products, kept as terms until they are needed.

`2 * x + 3 * y - a @ z` is three terms. Evaluated, they are one union and one aggregate, whatever
their number, with a join for each product only; terms over the same vector or matrix are one.
Products and quotients of two vectors place by place, and functions of vectors, need their values,
so they evaluate their operands.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector

Number = (int, float)


@dataclass(frozen=True)
class Product:
    """A matrix (or its transpose) times a vector, not yet made."""

    matrix: Matrix
    x: Vector
    transposed: bool = False

    @property
    def n(self) -> int:
        return self.matrix.m if self.transposed else self.matrix.n

    def rows(self, factor: float) -> DataFrame:
        row, column = ("j", "i") if self.transposed else ("i", "j")
        x = self.x if self.x.dense or self.x.zero == 0 else self.x.to_dense()
        entries = self.matrix.df.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col("v").alias("e"))
        return entries.join(x.df.select(F.col("i").alias("c"), F.col("v").alias("x")), "c").select(F.col("r").alias("i"), (F.lit(float(factor)) * F.col("e") * F.col("x")).alias("v"))


class VectorSum:
    """A sum of scaled vectors and products; value is the vector that it stands for, made when first asked for."""

    def __init__(self, terms: list[tuple[float, "Vector | Product"]]):
        merged: list[tuple[float, Vector | Product]] = []
        for f, x in terms:
            k = next((k for k, (_, y) in enumerate(merged) if y is x), None)
            if k is None:
                merged.append((f, x))
            else:
                merged[k] = (merged[k][0] + f, x)
        if len({x.n for _, x in merged}) > 1:
            raise ValueError(f"vectors of {' and '.join(str(x.n) for _, x in merged)} values")
        self.terms = merged

    @property
    def n(self) -> int:
        return self.terms[0][1].n

    @cached_property
    def value(self) -> Vector:
        used = [(f, x) for f, x in self.terms if f != 0]
        if not used:
            return Vector.fill(self.terms[0][1].df.sparkSession if isinstance(self.terms[0][1], Vector) else self.terms[0][1].matrix.df.sparkSession, self.n, 0.0)
        if len(used) == 1 and isinstance(used[0][1], Vector):
            return used[0][1] if used[0][0] == 1 else used[0][1].scalar("mult", used[0][0])
        zero, parts, dense = 0.0, [], False
        for f, x in used:
            if isinstance(x, Product):
                parts.append(x.rows(f))
                continue
            z = 0.0 if x.dense else x.zero
            zero, dense = zero + f * z, dense or x.dense
            parts.append(x.df.select("i", (F.lit(float(f)) * (F.col("v") - z if z else F.col("v"))).alias("v")))
        if not dense and any(isinstance(x, Product) for _, x in used):
            spark = parts[0].sparkSession
            parts.append(spark.range(self.n).select(F.col("id").alias("i"), F.lit(0.0).alias("v")))
            dense = True
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        total = F.sum("v") + zero if zero else F.sum("v")
        return Vector(whole.groupBy("i").agg(total.alias("v")), self.n, zero, dense)

    @property
    def df(self) -> DataFrame:
        return self.value.df

    def _terms_of(self, other) -> list:
        found = as_sum(other)
        if found is None:
            raise TypeError(f"a vector and {type(other).__name__}")
        return found.terms

    def __add__(self, other):
        return self.value.scalar("add", other) if isinstance(other, Number) else VectorSum(self.terms + self._terms_of(other))

    def __sub__(self, other):
        return self.value.scalar("sub", other) if isinstance(other, Number) else VectorSum(self.terms + [(-f, x) for f, x in self._terms_of(other)])

    def __radd__(self, other):
        return self + other

    def __rsub__(self, other):
        return (-self) + other

    def __neg__(self):
        return VectorSum([(-f, x) for f, x in self.terms])

    def __mul__(self, other):
        return VectorSum([(f * other, x) for f, x in self.terms]) if isinstance(other, Number) else self.value.binary("mult", value_of(other))

    __rmul__ = __mul__

    def __truediv__(self, other):
        return VectorSum([(f / other, x) for f, x in self.terms]) if isinstance(other, Number) and other else self.value.scalar("divide", other) if isinstance(other, Number) else self.value.binary("divide", value_of(other))

    def __rtruediv__(self, other):
        return self.value.scalar("divide", other, swap=True)


class MatrixSum:
    """A sum of scaled matrices; value is one union and one aggregate of all of them."""

    def __init__(self, terms: list[tuple[float, Matrix]]):
        if len({(a.n, a.m) for _, a in terms}) > 1:
            raise ValueError(f"matrices of {' and '.join(f'{a.n} x {a.m}' for _, a in terms)}")
        self.terms = terms

    @cached_property
    def value(self) -> Matrix:
        used = [(f, a) for f, a in self.terms if f != 0] or [(0.0, self.terms[0][1])]
        if len(used) == 1:
            return used[0][1] if used[0][0] == 1 else used[0][1].scale(used[0][0])
        whole = used[0][1].scale(used[0][0]).df
        for f, a in used[1:]:
            whole = whole.unionByName(a.scale(f).df)
        return Matrix(whole.groupBy("i", "j").agg(F.sum("v").alias("v")), used[0][1].n, used[0][1].m)

    @property
    def df(self) -> DataFrame:
        return self.value.df

    def __add__(self, other):
        return MatrixSum(self.terms + as_matrix_sum(other).terms)

    def __sub__(self, other):
        return MatrixSum(self.terms + [(-f, a) for f, a in as_matrix_sum(other).terms])

    def __neg__(self):
        return MatrixSum([(-f, a) for f, a in self.terms])

    def __mul__(self, s: float):
        return MatrixSum([(f * s, a) for f, a in self.terms])

    __rmul__ = __mul__

    def __truediv__(self, s: float):
        return self * (1 / s)

    def __matmul__(self, other):
        """Times a vector: a term for each matrix, so that no sum of matrices is made; times a matrix: their product."""
        x = as_sum(other)
        if x is not None:
            return VectorSum([(f, Product(a, x.value)) for f, a in self.terms])
        return MatrixSum([(f * g, a.matmul(b)) for f, a in self.terms for g, b in as_matrix_sum(other).terms])


def as_sum(x) -> VectorSum | None:
    if isinstance(x, VectorSum):
        return x
    return VectorSum([(1.0, x)]) if isinstance(x, Vector | Product) else None


def as_matrix_sum(a) -> MatrixSum:
    if isinstance(a, MatrixSum):
        return a
    if isinstance(a, Matrix):
        return MatrixSum([(1.0, a)])
    raise TypeError(f"a matrix and {type(a).__name__}")


def value_of(x) -> Vector:
    found = as_sum(x)
    if found is None:
        raise TypeError(f"a vector and {type(x).__name__}")
    return found.value
