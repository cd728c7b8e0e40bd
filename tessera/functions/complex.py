"""Complex numbers as struct<re double, im double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import ieee_divide


def make(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def mult(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def norm(a: Column) -> Column:
    """The squared absolute value."""
    return a["re"] * a["re"] + a["im"] * a["im"]


def divide(a: Column, b: Column) -> Column:
    return make(ieee_divide(a["re"] * b["re"] + a["im"] * b["im"], norm(b)), ieee_divide(a["im"] * b["re"] - a["re"] * b["im"], norm(b)))


def conj(a: Column) -> Column:
    return make(a["re"], -a["im"])


def minus(a: Column) -> Column:
    return make(-a["re"], -a["im"])


def absolute(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def asum(a: Column) -> Column:
    return F.abs(a["re"]) + F.abs(a["im"])


def arg(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def exp(a: Column) -> Column:
    return make(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))


def sqrt(a: Column) -> Column:
    """The root with a real part of 0 or more."""
    r = absolute(a)
    im = F.sqrt(F.greatest((r - a["re"]) / 2, F.lit(0.0)))
    return make(F.sqrt(F.greatest((r + a["re"]) / 2, F.lit(0.0))), F.when(a["im"] < 0, -im).otherwise(im))
