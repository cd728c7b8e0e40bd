"""Scalar functions of vectors and matrices as Spark columns, with IEEE results where Spark has errors or nulls."""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b of doubles; x/0 is an infinity with the sign of x, 0/0 is NaN."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b != 0, a / b).otherwise(zero)


def ieee_log(v: Column) -> Column:
    """ln; 0 gives minus infinity and a negative value NaN."""
    return F.when(v > 0, F.ln(v)).when(v == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def ieee_remainder(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % b).otherwise(F.lit(NAN))


def rounded(v: "Column | str", digits: int = 0) -> Column:
    """A double to so many digits, halves away from 0, by the binary product v * 10^digits, as SQL engines without decimals do it.

    F.round goes by the shortest decimal that reads as v, which differs where v is next to a half.
    """
    v = F.col(v) if isinstance(v, str) else v
    m = 10.0**digits
    y = v * F.lit(m)
    near = F.rint(y)
    found = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near) / F.lit(m)
    return F.when(F.isnan(found) | (F.abs(found) == F.lit(INF)), v).otherwise(found)


def _whole(round_to, v: Column) -> Column:
    """floor or ceil as a double; values from 2^53 on are whole, and infinities and NaN stay."""
    return F.when(F.abs(v) < 2.0**53, round_to(v).cast("double")).otherwise(v)


UNARY = {
    "copy": lambda v: v,
    "conj": lambda v: v,
    "abs": F.abs,
    "asum": F.abs,
    "sqr": lambda v: v * v,
    "minus": lambda v: -v,
    "exp": F.exp,
    "sqrt": F.sqrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "atan": F.atan,
    "log": ieee_log,
    "floor": lambda v: _whole(F.floor, v),
    "ceil": lambda v: _whole(F.ceil, v),
    "sign": lambda v: F.when(F.isnan(v), F.lit(0.0)).otherwise(F.signum(v)),
    "reciprocal": lambda v: ieee_divide(F.lit(1.0), v),
}

BINARY = {
    "copy": lambda a, b: b,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mult": lambda a, b: a * b,
    "divide": ieee_divide,
    "modulo": ieee_remainder,
    "min": F.least,
    "max": F.greatest,
    "abs_max": lambda a, b: F.greatest(F.abs(a), F.abs(b)),
    "abs_diff": lambda a, b: F.abs(a - b),
    "pow": F.pow,
    "copy_sign": lambda a, b: F.abs(a) * F.when(b < 0, F.lit(-1.0)).otherwise(F.lit(1.0)),
}

#: What an operation leaves as it is: the value of an empty reduction.
NEUTRAL = {"add": 0.0, "sub": 0.0, "mult": 1.0, "divide": 1.0, "min": INF, "max": -INF, "abs_max": 0.0}

COMPARE = {"lt": operator.lt, "le": operator.le, "ge": operator.ge, "gt": operator.gt, "eq": operator.eq, "ne": operator.ne}

#: Operations with op(0, y) = 0: a sparse left side with zero 0 decides the pattern of the result.
KEEPS_ZERO = {"mult", "divide"}


def aggregate(op: str, v: Column) -> Column:
    """Aggregate function that reduces a column by a binary operation."""
    if op in ("add", "sub"):
        return F.sum(v)
    if op in ("mult", "divide"):
        return F.product(v)
    return {"min": F.min, "max": F.max, "abs_max": lambda x: F.max(F.abs(x))}[op](v)


def python_value(op: str, *values: float) -> float:
    """The same operation on Python floats, with IEEE results, for the implicit values of sparse vectors."""
    a, b = np.float64(values[0]), np.float64(values[-1])
    table = {
        "copy": lambda: b,
        "conj": lambda: a,
        "abs": lambda: np.abs(a),
        "asum": lambda: np.abs(a),
        "sqr": lambda: a * a,
        "minus": lambda: -a,
        "exp": lambda: np.exp(a),
        "sqrt": lambda: np.sqrt(a),
        "sin": lambda: np.sin(a),
        "cos": lambda: np.cos(a),
        "tan": lambda: np.tan(a),
        "atan": lambda: np.arctan(a),
        "log": lambda: np.log(a),
        "floor": lambda: np.floor(a),
        "ceil": lambda: np.ceil(a),
        "sign": lambda: 0.0 if np.isnan(a) else np.sign(a),
        "reciprocal": lambda: python_value("divide", 1.0, a),
        "add": lambda: a + b,
        "sub": lambda: a - b,
        "mult": lambda: a * b,
        "divide": lambda: a / b if b else (NAN if a == 0 or np.isnan(a) else np.copysign(INF, a)),
        "modulo": lambda: np.fmod(a, b),
        "min": lambda: _order(a, b)[0],
        "max": lambda: _order(a, b)[1],
        "abs_max": lambda: _order(np.abs(a), np.abs(b))[1],
        "abs_diff": lambda: np.abs(a - b),
        "pow": lambda: NAN if np.abs(a) == 1 and not np.isfinite(b) else np.power(a, b),  # as Spark has it
        "copy_sign": lambda: np.abs(a) * (-1.0 if b < 0 else 1.0),
    }
    with np.errstate(all="ignore"):
        return float(table[op]())


def _order(a: float, b: float) -> list[float]:
    """The smaller and the greater value; NaN is greater than all, as Spark has it."""
    return sorted((a, b), key=lambda x: (np.isnan(x), x))
