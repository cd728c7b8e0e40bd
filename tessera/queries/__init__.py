"""Registry of the array and matrix queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import algebra, complexes, elementwise, files, grids, joins, order, partitions, reductions, systems
from tessera.queries.inputs import Tables, vector_out

MODULES = (elementwise, joins, reductions, algebra, complexes, order, grids, partitions, files, systems)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each order at list prices: a sparse matrix of quantities times the vector of prices."""
    t = Tables(spark, sf_dir)
    return vector_out(t.a.times(t.p))


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
