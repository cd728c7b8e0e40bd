"""Reading and writing by file suffix, with formats of one's own; Parquet is the native form."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans.complex import ComplexMatrix
from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector
from tessera.sources import binary, text


def _native_write(x: "Vector | Matrix", path: str) -> None:
    """Rows as Parquet, shape and implicit value as one row of JSON beside them."""
    spark = x.df.sparkSession
    about = {"n": x.n, "zero": x.zero, "dense": x.dense} if isinstance(x, Vector) else {"n": x.n, "m": x.m}
    x.df.write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def _native_read(spark: SparkSession, path: str) -> "Vector | Matrix":
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    rows = spark.read.parquet(f"{path}/rows")
    return Matrix(rows, about["n"], about["m"]) if "m" in about else Vector(rows, about["n"], about["zero"], about["dense"])


READERS: dict[str, Callable[[SparkSession, str], "Vector | Matrix"]] = {
    "tsr": _native_read,
    "mtx": text.read_mtx,
    "txt": text.read_txt,
    "psc": binary.read_petsc,
    "mat": binary.read_mat,
    "frm": lambda spark, path: binary.read_samg(spark, path, path[:-3] + "amg"),
    "frv": lambda spark, path: binary.read_samg_vector(spark, path, path[:-3] + "vec"),
    "bmp": lambda spark, path: binary.read_image(spark, path)[0],
    "png": lambda spark, path: binary.read_image(spark, path)[0],
}
WRITERS: dict[str, Callable[["Vector | Matrix", str], None]] = {
    "tsr": _native_write,
    "mtx": lambda x, path: text.write_mtx_complex(x, path) if isinstance(x, ComplexMatrix) else text.write_mtx_vector(x, path) if isinstance(x, Vector) else text.write_mtx(x, path),
    "txt": text.write_txt,
    "psc": binary.write_petsc,
    "mat": binary.write_mat,
    "frm": binary.write_samg,
    "frv": binary.write_samg_vector,
    "bmp": binary.write_image,
    "png": binary.write_image,
}


def register(suffix: str, read: Callable | None = None, write: Callable | None = None) -> None:
    """Make a file format of one's own known."""
    if read:
        READERS[suffix] = read
    if write:
        WRITERS[suffix] = write


def suffix_of(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read(spark: SparkSession, path: str) -> "Vector | Matrix":
    return READERS[suffix_of(path)](spark, path)


def write(x: "Vector | Matrix", path: str, kind: str | None = None) -> None:
    """By the path's suffix. kind casts the values before (float, int, ...). Images are vectors with a shape: see binary.Image."""
    if kind:
        x = x.cast(kind) if isinstance(x, Vector) else x._with(F.col("v").cast(kind).cast("double"))
    WRITERS[suffix_of(path)](x, path)


def convert(spark: SparkSession, source: str, target: str) -> None:
    write(read(spark, source), target)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)
