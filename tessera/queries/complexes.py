"""Complex vectors and matrices: parts x suppliers, quantities real and discounts imaginary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.plans.complex import FORMS, ComplexMatrix, ComplexVector
from tessera.plans.storage import shared_dir
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables
from tessera.sources import files

R = Registry()
T = Tables

_M = "(SELECT coalesce(s.i, d.i) AS i, coalesce(s.j, d.j) AS j, coalesce(s.v, 0) AS re, coalesce(d.v, 0) AS im FROM s FULL JOIN d ON s.i = d.i AND s.j = d.j)"
_P = "(SELECT i, v / 1000 AS re, i % 7 - 3.0 AS im FROM p)"
_Q = "(SELECT s_suppkey AS i, s_suppkey % 5 - 2.0 AS re, s_suppkey % 3 + 0.5 AS im FROM supplier)"


def _matrix(s, d) -> ComplexMatrix:
    return ComplexMatrix.of(T(s, d).s, T(s, d).d)


def _parts(s, d) -> ComplexVector:
    p = T(s, d).p
    return ComplexVector.of(p.scalar("divide", 1000.0), Vector(p.df.select("i", (F.col("i") % 7 - 3).cast("double").alias("v")), p.n))


def _suppliers(s, d) -> ComplexVector:
    n = T(s, d).size("supplier", "s_suppkey")
    rows = T(s, d).table("supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 5 - 2.0).alias("re"), (F.col("s_suppkey") % 3 + 0.5).alias("im"))
    return ComplexVector(rows, n)


def _out(x, digits: int = 4):
    keys = ["i"] if isinstance(x, ComplexVector) else ["i", "j"]
    return x.df.select(*keys, rounded("re", digits).alias("re"), rounded("im", digits).alias("im"))


def _product_sql(form: str) -> str:
    swap, conjugate = FORMS[form]
    row, col, x, base = ("j", "i", _P, _Q) if swap else ("i", "j", _Q, _P)
    sign = -1 if conjugate else 1
    # (2 - i) * sum + 0.5 i * base
    re, im = f"m.re * x.re - {sign} * m.im * x.im", f"m.re * x.im + {sign} * m.im * x.re"
    sums = f"(SELECT m.{row} AS i, sum({re}) AS re, sum({im}) AS im FROM {_M} m JOIN {x} x ON m.{col} = x.i GROUP BY 1)"
    return f"SELECT b.i, round(2 * coalesce(q.re, 0) + coalesce(q.im, 0) - 0.5 * b.im, 6) AS re, round(2 * coalesce(q.im, 0) - coalesce(q.re, 0) + 0.5 * b.re, 6) AS im FROM {base} b LEFT JOIN {sums} q ON b.i = q.i"


def _product(s, d, form: str):
    x, y = (_parts(s, d), _suppliers(s, d)) if FORMS[form][0] else (_suppliers(s, d), _parts(s, d))
    return _out(_matrix(s, d).times(x, 2 - 1j, y, 0.5j, form), 6)


for _form in FORMS:
    R.add(f"l01_complex_gemv_{_form}", lambda s, d, f=_form: _product(s, d, f), _product_sql(_form))
R.add("a04_complex_l1_norm", lambda s, d: _parts(s, d).l1_norm().select(rounded("v", 4).alias("v")), f"SELECT round(sum(abs(re) + abs(im)), 4) AS v FROM {_P}")
R.add("a05_complex_l2_norm", lambda s, d: _parts(s, d).l2_norm().select(rounded("v", 4).alias("v")), f"SELECT round(sqrt(sum(re * re + im * im)), 4) AS v FROM {_P}")
R.add("a06_complex_max_norm", lambda s, d: _parts(s, d).max_norm().select(rounded("v", 4).alias("v")), f"SELECT round(max(sqrt(re * re + im * im)), 4) AS v FROM {_P}")


@R.query("a08_complex_dot_product", f"SELECT round(sum(a.re * b.re + a.im * b.im), 3) AS re, round(sum(a.re * b.im - a.im * b.re), 3) AS im FROM {_P} a JOIN (SELECT i, 3 - im AS re, re AS im FROM {_P}) b ON a.i = b.i")
def _(s, d):
    """The left side is conjugated."""
    x = _parts(s, d)
    y = ComplexVector(x.df.select("i", (3 - F.col("im")).alias("re"), F.col("re").alias("im")), x.n)
    return x.dot(y).select(rounded("re", 3).alias("re"), rounded("im", 3).alias("im"))


R.add("e03_complex_sum", lambda s, d: _out(_parts(s, d).plus(_parts(s, d).conj(), 1j, 2.0)), f"SELECT i, round(2 * re - im, 4) AS re, round(re - 2 * im, 4) AS im FROM {_P}")
R.add("l09_conjugate_transpose", lambda s, d: _out(_matrix(s, d).form("conj_transpose")), f"SELECT j AS i, i AS j, round(re, 4) AS re, round(-im, 4) AS im FROM {_M}")
R.add("l10_complex_parts", lambda s, d: _matrix(s, d).real().df.withColumnRenamed("v", "re").join(_matrix(s, d).imag().df.withColumnRenamed("v", "im"), ["i", "j"]).select("i", "j", rounded("re", 4).alias("re"), rounded("im", 4).alias("im")), f"SELECT i, j, round(re, 4) AS re, round(im, 4) AS im FROM {_M}")


@R.query("l13_hermitian_product", f"SELECT a.j AS i, b.j, round(sum(a.re * b.re + a.im * b.im), 6) AS re, round(sum(a.re * b.im - a.im * b.re), 6) AS im FROM {_M} a JOIN {_M} b ON a.i = b.i GROUP BY a.j, b.j")
def _(s, d):
    """conj(A)^T A."""
    m = _matrix(s, d)
    rows = m.matmul(m, "conj_transpose").df
    return rows.select("i", "j", rounded("re", 6).alias("re"), rounded("im", 6).alias("im"))


@R.query("io01_complex_mtx", f"SELECT i, j, round(re, 4) AS re, round(im, 4) AS im FROM {_M}")
def _(s, d):
    path = f"{shared_dir(s)}/tessera/file-{uuid.uuid4().hex}.mtx"
    files.write(_matrix(s, d), path)
    return _out(files.read(s, path))
