"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUN = "spark.tessera.run"
#: Tables of more rows than these are shuffled for a join: few bytes of a file can hold many rows, all of which a broadcast takes through the driver.
BROADCAST_ROWS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (in local tests only) a folder of our own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.tessera.shared.dir", None)
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.shared.dir", base)
    return base.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of the run's tables: that of scratch(), or one for all that is outside of it."""
    return f"{shared_dir(spark)}/tessera/{spark.conf.get(RUN, 'tables')}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it, tables go to a folder of their own, which is removed at the end: results must be written or collected before."""
    before = spark.conf.get(RUN, None)
    spark.conf.set(RUN, f"run-{uuid.uuid4().hex}")
    path = run_dir(spark)
    try:
        yield path
    finally:
        if before is None:
            spark.conf.unset(RUN)
        else:
            spark.conf.set(RUN, before)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, which joins don't broadcast if they are many."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df as a written table, for loops. (A checkpoint keeps the constraints that the optimizer inferred, which grow from step to step.)"""
    return stored(df, "step", "lz4")


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that cut() wrote, which nothing reads any more: loops over large tables keep one of them at a time."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/step-" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_buckets(df: DataFrame, by: str, n: int) -> DataFrame:
    """df as a written table in n buckets of a column: lineage ends, and joins by it don't move the rows."""
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").option("path", f"{run_dir(spark)}/{name}").bucketBy(n, by).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay
    return held
