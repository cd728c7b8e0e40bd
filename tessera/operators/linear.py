"""Linear operators as objects: matrices, their sums, products, transposes, multiples of the identity and stencils.

apply() lowers a sum to one aggregate: the matrices in it, which meet the same vector, become one
table of entries and one join, and the rows of all other terms are added to theirs. Solvers take
operators by solver_operator().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.solvers import Operator
from tessera.plans.grid import Grid, Stencil, neighbours
from tessera.plans.matrix import Matrix
from tessera.plans.sparse import Held
from tessera.plans.storage import cut
from tessera.plans.vector import Vector

c = F.col


class Linear:
    """n x m; rows(x) are contributions (i, v), of which a place may have several."""

    n: int
    m: int

    def rows(self, x: Vector) -> DataFrame:
        raise NotImplementedError

    @property
    def T(self) -> "Linear":  # noqa: N802
        raise NotImplementedError

    def diagonal(self) -> DataFrame:
        """(i, v) of the diagonal, contributions that are to be added up."""
        raise NotImplementedError

    def apply(self, x: Vector) -> Vector:
        """The product, a dense vector: contributions and a 0 for every place under one aggregate."""
        if x.n != self.m:
            raise ValueError(f"{self.n} x {self.m} times {x.n} values")
        every = x.df.sparkSession.range(self.n).select(c("id").alias("i"), F.lit(0.0).alias("v"))
        return Vector(self.rows(x).unionByName(every).groupBy("i").agg(F.sum("v").alias("v")), self.n)

    def solver_operator(self, with_diagonal: bool = False) -> Operator:
        """What solvers take in place of a matrix."""
        if self.n != self.m:
            raise ValueError(f"{self.n} x {self.m} is not square")
        d = None
        if with_diagonal:
            d = Vector(cut(self.diagonal().groupBy("i").agg(F.sum("v").alias("v"))), self.n, 0.0, False).to_dense()
        kept = self.held({})
        return Operator(self.n, kept.apply, kept.T.apply, d)

    def held(self, made: dict[int, Held]) -> "Linear":
        """The same with its matrices in a form for many products; made has those that are there already, by their tables."""
        return self

    def __add__(self, other: "Linear") -> "Linear":
        return Sum((*_terms(self), *_terms(other)))

    def __sub__(self, other: "Linear") -> "Linear":
        return self + (-1.0) * other

    def __neg__(self) -> "Linear":
        return (-1.0) * self

    def __rmul__(self, s: float) -> "Linear":
        return Scaled(self, float(s))

    def __matmul__(self, other):
        return self.apply(other) if isinstance(other, Vector) else Chain(self, other)


def _terms(a: Linear) -> tuple[Linear, ...]:
    return a.terms if isinstance(a, Sum) else (a,)


@dataclass(frozen=True)
class Of(Linear):
    """A matrix, times a factor."""

    matrix: Matrix
    factor: float = 1.0
    transposed: bool = False

    @property
    def n(self) -> int:
        return self.matrix.m if self.transposed else self.matrix.n

    @property
    def m(self) -> int:
        return self.matrix.n if self.transposed else self.matrix.m

    def entries(self) -> DataFrame:
        row, column = ("j", "i") if self.transposed else ("i", "j")
        return self.matrix.df.select(c(row).alias("r"), c(column).alias("c"), (F.lit(self.factor) * c("v")).alias("e"))

    def rows(self, x: Vector) -> DataFrame:
        if isinstance(self.matrix, Held):
            x = x if x.dense or x.zero == 0 else x.to_dense()
            return self.matrix.sums(x.df, self.transposed).select("i", (F.lit(self.factor) * c("v")).alias("v"))
        return _joined(self.entries(), x)

    def held(self, made: dict[int, Held]) -> Linear:
        if id(self.matrix) not in made:
            made[id(self.matrix)] = Held.of(self.matrix)
        return Of(made[id(self.matrix)], self.factor, self.transposed)

    @property
    def T(self) -> Linear:  # noqa: N802
        return Of(self.matrix, self.factor, not self.transposed)

    def __rmul__(self, s: float) -> Linear:
        return Of(self.matrix, self.factor * s, self.transposed)

    def diagonal(self) -> DataFrame:
        return self.matrix.df.filter("i = j").select("i", (F.lit(self.factor) * c("v")).alias("v"))


def _joined(entries: DataFrame, x: Vector) -> DataFrame:
    x = x if x.dense or x.zero == 0 else x.to_dense()
    return entries.join(x.df.select(c("i").alias("c"), c("v").alias("x")), "c").select(c("r").alias("i"), (c("e") * c("x")).alias("v"))


@dataclass(frozen=True)
class Shift(Linear):
    """A multiple of the identity."""

    size: int
    factor: float = 1.0

    @property
    def n(self) -> int:
        return self.size

    @property
    def m(self) -> int:
        return self.size

    def rows(self, x: Vector) -> DataFrame:
        x = x if x.dense or x.zero == 0 else x.to_dense()
        return x.df.select("i", (F.lit(float(self.factor)) * c("v")).alias("v"))

    @property
    def T(self) -> Linear:  # noqa: N802
        return self

    def __rmul__(self, s: float) -> Linear:
        return Shift(self.size, self.factor * s)

    def diagonal(self) -> DataFrame:
        raise ValueError("only as a part of a sum with a matrix: the session isn't known")


@dataclass(frozen=True)
class OnGrid(Linear):
    """A stencil on a grid, times a factor; its matrix is never made."""

    grid: Grid
    stencil: Stencil
    factor: float = 1.0

    @property
    def n(self) -> int:
        return self.grid.size

    @property
    def m(self) -> int:
        return self.grid.size

    def rows(self, x: Vector) -> DataFrame:
        """Each value goes to the places whose stencils reach it: by the mirrored stencil, without a join."""
        x = x if x.dense or x.zero == 0 else x.to_dense()
        sent = neighbours(x.df, self.grid, self.stencil.mirrored(), ("v",))
        return sent.select(c("j").alias("i"), (F.lit(self.factor) * c("w") * c("v")).alias("v"))

    @property
    def T(self) -> Linear:  # noqa: N802
        return OnGrid(self.grid, self.stencil.mirrored(), self.factor)

    def __rmul__(self, s: float) -> Linear:
        return OnGrid(self.grid, self.stencil, self.factor * s)


@dataclass(frozen=True)
class Scaled(Linear):
    inner: Linear
    factor: float

    @property
    def n(self) -> int:
        return self.inner.n

    @property
    def m(self) -> int:
        return self.inner.m

    def rows(self, x: Vector) -> DataFrame:
        return self.inner.rows(x).select("i", (F.lit(self.factor) * c("v")).alias("v"))

    def held(self, made: dict[int, Held]) -> Linear:
        return Scaled(self.inner.held(made), self.factor)

    @property
    def T(self) -> Linear:  # noqa: N802
        return Scaled(self.inner.T, self.factor)

    def diagonal(self) -> DataFrame:
        return self.inner.diagonal().select("i", (F.lit(self.factor) * c("v")).alias("v"))


@dataclass(frozen=True)
class Sum(Linear):
    terms: tuple[Linear, ...]

    def __post_init__(self):
        if len({(t.n, t.m) for t in self.terms}) > 1:
            raise ValueError(f"operators of {' and '.join(f'{t.n} x {t.m}' for t in self.terms)}")

    @property
    def n(self) -> int:
        return self.terms[0].n

    @property
    def m(self) -> int:
        return self.terms[0].m

    def rows(self, x: Vector) -> DataFrame:
        joined = [isinstance(t, Of) and not isinstance(t.matrix, Held) for t in self.terms]
        matrices = [t.entries() for t, j in zip(self.terms, joined) if j]
        parts = [t.rows(x) for t, j in zip(self.terms, joined) if not j]
        if matrices:
            parts.append(_joined(_union(matrices), x))
        return _union(parts)

    def held(self, made: dict[int, Held]) -> Linear:
        """Matrices that are terms become one."""
        matrices = [t for t in self.terms if isinstance(t, Of)]
        if len(matrices) < 2:
            return Sum(tuple(t.held(made) for t in self.terms))
        entries = _union([t.entries() for t in matrices]).groupBy(c("r").alias("i"), c("c").alias("j")).agg(F.sum("e").alias("v"))
        return Sum((Of(Held.of(Matrix(entries, self.n, self.m))), *(t.held(made) for t in self.terms if not isinstance(t, Of))))

    @property
    def T(self) -> Linear:  # noqa: N802
        return Sum(tuple(t.T for t in self.terms))

    def __rmul__(self, s: float) -> Linear:
        return Sum(tuple(s * t for t in self.terms))

    def diagonal(self) -> DataFrame:
        shift = sum(t.factor for t in self.terms if isinstance(t, Shift))
        parts = [t.diagonal() for t in self.terms if not isinstance(t, Shift)]
        if shift:
            parts.append(parts[0].sparkSession.range(self.n).select(c("id").alias("i"), F.lit(float(shift)).alias("v")))
        return _union(parts)


@dataclass(frozen=True)
class Chain(Linear):
    """left times right; a matrix is never made of them."""

    left: Linear
    right: Linear

    def __post_init__(self):
        if self.left.m != self.right.n:
            raise ValueError(f"{self.left.n} x {self.left.m} times {self.right.n} x {self.right.m}")

    @property
    def n(self) -> int:
        return self.left.n

    @property
    def m(self) -> int:
        return self.right.m

    def rows(self, x: Vector) -> DataFrame:
        return self.left.rows(self.right.apply(x))

    def held(self, made: dict[int, Held]) -> Linear:
        return Chain(self.left.held(made), self.right.held(made))

    @property
    def T(self) -> Linear:  # noqa: N802
        return Chain(self.right.T, self.left.T)

    def diagonal(self) -> DataFrame:
        """For matrices: sums of the products of a row of the left and the same column of the right one."""
        if not isinstance(self.left, Of) or not isinstance(self.right, Of):
            raise ValueError("the diagonal of this product isn't known without making it")
        right = self.right.entries().select(c("r").alias("c"), c("c").alias("r"), c("e").alias("f"))
        return self.left.entries().join(right, ["r", "c"]).select(c("r").alias("i"), (c("e") * c("f")).alias("v"))


def gramian(a: "Matrix | Linear") -> Linear:
    """The transpose times the matrix."""
    a = Of(a) if isinstance(a, Matrix) else a
    return Chain(a.T, a)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
