"""Every array and matrix query against its SQL in DuckDB."""

from __future__ import annotations

import pytest

import tessera.queries as base
from tests.compare import connect, difference

QUERIES, SQL = base.queries(), base.oracle_sql()
SLOW = tuple(f"v{k:02d}" for k in range(1, 23))  # solvers: tests/test_library.py


@pytest.fixture(scope="module")
def oracle(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(SLOW) or n.startswith(("v18_power_steps", "v19", "v20"))])
def test_query_matches_its_sql(spark, data, oracle, name):
    got = QUERIES[name](spark, data).toPandas()
    assert difference(got, oracle.execute(SQL[name]).df()) is None


def test_flagship_has_a_row_for_each_order(spark, data):
    assert base.flagship(spark, data).count() == spark.read.parquet(f"{data}/orders.parquet").count()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
