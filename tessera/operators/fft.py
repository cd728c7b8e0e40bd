"""Fourier transforms of complex tables (i, re, im), in two steps over groups of about the root of the length."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector


def next_power_of_two(n: int) -> int:
    return 1 if n < 1 else 1 << (n - 1).bit_length()


def _check(n: int) -> None:
    if n < 1 or n & (n - 1):
        raise ValueError(f"the length {n} isn't a power of two")


#: Complex values that a worker transforms at once.
BLOCK = 1 << 20
#: Longer rows and columns are transformed in two steps.
WHOLE = 256


def _transformed(x: DataFrame, key: str, at: str, n: int, inverse: bool) -> DataFrame:
    """(key, at, re, im): the values of each key transformed over the places 0 to n - 1; places without a row are 0.

    A key's values are packed into one row by the shuffle, and many rows are transformed by one call.
    """
    packed = x.groupBy(key).agg(F.collect_list(F.struct(F.col(at).cast("long").alias("at"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("e"))
    packed = packed.select(F.col(key).cast("long").alias("key"), F.col("e.at").alias("at"), F.col("e.re").alias("re"), F.col("e.im").alias("im"))
    schema = pa.schema([(key, pa.int64()), (at, pa.int64()), ("re", pa.float64()), ("im", pa.float64())])
    step = max(1, BLOCK // n)

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                b = whole.slice(first, step)
                places = b.column("at")
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(places).to_numpy(zero_copy_only=False))
                z = np.zeros((b.num_rows, n), complex)
                z[row, places.flatten().to_numpy()] = b.column("re").flatten().to_numpy() + 1j * b.column("im").flatten().to_numpy()
                z = np.fft.ifft(z, axis=1) * n if inverse else np.fft.fft(z, axis=1)
                keys = np.repeat(b.column("key").to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.arange(n), b.num_rows)), pa.array(z.real.ravel()), pa.array(z.imag.ravel())], schema=schema)

    return packed.mapInArrow(run, f"{key} long, {at} long, re double, im double")


def _long(x: DataFrame, key: str, at: str, n: int, inverse: bool) -> DataFrame:
    """As _transformed(), in two steps over groups of at most 2 * sqrt(n) values each.

    With at = a + n1 * b: for each key and a the transform over b, a twiddle factor, and for each
    result index c the transform over a, which gives place c + n2 * d.
    """
    n1 = 1 << (n.bit_length() - 1) // 2
    n2 = n // n1
    k, i = F.col(key).cast("long"), F.col(at).cast("long")
    rows = x.select((k * n1 + i % n1).alias("g"), F.floor(i / n1).cast("long").alias("b"), "re", "im")
    first = _transformed(rows, "g", "b", n2, inverse)
    a, b = F.col("g") % n1, F.col("b")
    angle = F.lit((2 if inverse else -2) * math.pi / n) * a * b
    turned = first.select((F.floor(F.col("g") / n1) * n2 + b).alias("g"), a.alias("a"), (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im"))
    second = _transformed(turned, "g", "a", n1, inverse)
    return second.select(F.floor(F.col("g") / n2).cast("long").alias(key), (F.col("g") % n2 + F.col("a") * n2).alias(at), "re", "im")


def fft(x: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """(i, re, im) for x (i, re, im) of length n, a power of two; forward with exp(-2 pi i), the inverse is not divided by n. Two shuffles whatever the length."""
    _check(n)
    return _long(x.withColumn("key", F.lit(0)), "key", "i", n, inverse).select("i", "re", "im")


def fft_vector(x: Vector, inverse: bool = False) -> DataFrame:
    """The transform of a real vector, filled up with 0 to a power of two."""
    return fft(x.df.select("i", F.col("v").alias("re"), F.lit(0.0).alias("im")), next_power_of_two(x.n), inverse)


def fft_rows(x: DataFrame, m: int, inverse: bool = False, dim: int = 1) -> DataFrame:
    """(i, j, re, im): each row (dim 1) or column (dim 0) of a complex matrix (i, j, re, im) transformed; m is its length. Those longer than WHOLE are no group of one task."""
    _check(m)
    key, at = ("i", "j") if dim == 1 else ("j", "i")
    return (_transformed if m <= WHOLE else _long)(x, key, at, m, inverse).select("i", "j", "re", "im")


def fft_2d(x: DataFrame, n: int, m: int, inverse: bool = False) -> DataFrame:
    return fft_rows(fft_rows(x, m, inverse, 1), n, inverse, 0)


def complex_matrix(a: Matrix) -> DataFrame:
    return a.df.select("i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im"))
