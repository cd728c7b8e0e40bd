"""Complex vectors (i, re, im) and matrices (i, j, re, im), for products with conjugates, norms and files."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import products
from tessera.plans.matrix import HOT_INNER, Matrix, paired
from tessera.plans.vector import Vector

#: Forms of a matrix in a product: whether it is transposed, whether its values are conjugated.
FORMS = {"normal": (False, False), "conj": (False, True), "transpose": (True, False), "conj_transpose": (True, True)}


def _scaled(s: complex, re: Column, im: Column) -> tuple[Column, Column]:
    s = complex(s)
    return F.lit(s.real) * re - F.lit(s.imag) * im, F.lit(s.real) * im + F.lit(s.imag) * re


@dataclass(frozen=True)
class ComplexVector:
    """df (i long, re double, im double) with unique 0 <= i < n; indexes without a row are 0."""

    df: DataFrame
    n: int

    @classmethod
    def of(cls, re: Vector, im: Vector | None = None) -> "ComplexVector":
        """From its real and imaginary parts."""
        if im is None:
            return cls(re.to_dense().df.select("i", F.col("v").alias("re"), F.lit(0.0).alias("im")), re.n)
        rows = re.to_dense().df.select("i", F.col("v").alias("re")).join(im.to_dense().df.select("i", F.col("v").alias("im")), "i")
        return cls(rows, re.n)

    def real(self) -> Vector:
        return Vector(self.df.select("i", F.col("re").alias("v")), self.n, 0.0, False)

    def imag(self) -> Vector:
        return Vector(self.df.select("i", F.col("im").alias("v")), self.n, 0.0, False)

    def conj(self) -> "ComplexVector":
        return replace(self, df=self.df.select("i", "re", (-F.col("im")).alias("im")))

    def scale(self, s: complex) -> "ComplexVector":
        re, im = _scaled(s, F.col("re"), F.col("im"))
        return replace(self, df=self.df.select("i", re.alias("re"), im.alias("im")))

    def plus(self, other: "ComplexVector", a: complex = 1.0, b: complex = 1.0) -> "ComplexVector":
        rows = self.scale(a).df.unionByName(other.scale(b).df)
        return replace(self, df=rows.groupBy("i").agg(F.sum("re").alias("re"), F.sum("im").alias("im")))

    def dot(self, other: "ComplexVector") -> DataFrame:
        """(re, im) of the sum of conj(self) * other."""
        rows = self.df.join(other.df.select("i", F.col("re").alias("x"), F.col("im").alias("y")), "i")
        re, im = F.col("re") * F.col("x") + F.col("im") * F.col("y"), F.col("re") * F.col("y") - F.col("im") * F.col("x")
        return rows.agg(F.coalesce(F.sum(re), F.lit(0.0)).alias("re"), F.coalesce(F.sum(im), F.lit(0.0)).alias("im"))

    def l1_norm(self) -> DataFrame:
        """The sum of the absolute values of both parts."""
        return self.df.agg(F.coalesce(F.sum(F.abs("re") + F.abs("im")), F.lit(0.0)).alias("v"))

    def l2_norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.coalesce(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.lit(0.0))).alias("v"))

    def max_norm(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.max(F.hypot("re", "im")), F.lit(0.0)).alias("v"))


@dataclass(frozen=True)
class ComplexMatrix:
    """df (i long, j long, re double, im double) with unique (i, j); places without a row are 0."""

    df: DataFrame
    n: int
    m: int

    @classmethod
    def of(cls, re: Matrix, im: Matrix) -> "ComplexMatrix":
        """From its real and imaginary parts, on the union of their places."""
        zero = F.lit(0.0)
        rows = re.df.select("i", "j", F.col("v").alias("re")).join(im.df.select("i", "j", F.col("v").alias("im")), ["i", "j"], "full")
        return cls(rows.select("i", "j", F.coalesce("re", zero).alias("re"), F.coalesce("im", zero).alias("im")), re.n, re.m)

    def real(self) -> Matrix:
        return Matrix(self.df.select("i", "j", F.col("re").alias("v")), self.n, self.m)

    def imag(self) -> Matrix:
        return Matrix(self.df.select("i", "j", F.col("im").alias("v")), self.n, self.m)

    def form(self, name: str) -> "ComplexMatrix":
        """The matrix as FORMS names it: normal, conj, transpose or conj_transpose."""
        swap, conjugate = FORMS[name]
        i, j = ("j", "i") if swap else ("i", "j")
        im = -F.col("im") if conjugate else F.col("im")
        rows = self.df.select(F.col(i).alias("i"), F.col(j).alias("j"), "re", im.alias("im"))
        return ComplexMatrix(rows, self.m if swap else self.n, self.n if swap else self.m)

    def scale(self, s: complex) -> "ComplexMatrix":
        re, im = _scaled(s, F.col("re"), F.col("im"))
        return replace(self, df=self.df.select("i", "j", re.alias("re"), im.alias("im")))

    def times(self, x: ComplexVector, a: complex = 1.0, y: ComplexVector | None = None, b: complex = 0.0, form: str = "normal") -> ComplexVector:
        """a * form(A) x + b * y: rows without entries give b * y."""
        left = self.form(form)
        rows = left.df.join(x.df.select(F.col("i").alias("j"), F.col("re").alias("x"), F.col("im").alias("y")), "j")
        re, im = F.col("re") * F.col("x") - F.col("im") * F.col("y"), F.col("re") * F.col("y") + F.col("im") * F.col("x")
        re, im = _scaled(a, re, im)
        products = rows.select("i", re.alias("re"), im.alias("im"))
        zero = F.lit(0.0)
        base = y.scale(b).df if y is not None and b != 0 else x.df.sparkSession.range(left.n).select(F.col("id").alias("i"), zero.alias("re"), zero.alias("im"))
        return ComplexVector(products.unionByName(base).groupBy("i").agg(F.sum("re").alias("re"), F.sum("im").alias("im")), left.n)

    def matmul(self, other: "ComplexMatrix", left: str = "normal", right: str = "normal") -> "ComplexMatrix":
        """left(A) right(B)."""
        a, b = self.form(left), other.form(right)
        if a.m >= products.LEAST:
            made = products.by_regions(a.df.select("i", F.col("j").alias("k"), "re", "im"), b.df.select(F.col("i").alias("k"), "j", "re", "im"), a.m, products.complex_, ["re", "im"], HOT_INNER)
            return ComplexMatrix(made, a.n, b.m)
        rows = paired(a.df.select("i", F.col("j").alias("k"), "re", "im"), b.df.select(F.col("i").alias("k"), "j", F.col("re").alias("x"), F.col("im").alias("y")), a.m)
        re, im = F.col("re") * F.col("x") - F.col("im") * F.col("y"), F.col("re") * F.col("y") + F.col("im") * F.col("x")
        return ComplexMatrix(rows.groupBy("i", "j").agg(F.sum(re).alias("re"), F.sum(im).alias("im")), a.n, b.m)

    def l2_norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.coalesce(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.lit(0.0))).alias("v"))

    def is_hermitian(self) -> DataFrame:
        other = self.form("conj_transpose").df.select("i", "j", F.col("re").alias("x"), F.col("im").alias("y"))
        zero = F.lit(0.0)
        same = (F.coalesce("re", zero) == F.coalesce("x", zero)) & (F.coalesce("im", zero) == F.coalesce("y", zero))
        return self.df.join(other, ["i", "j"], "full").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("ok"))
