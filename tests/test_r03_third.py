"""What the third review found, its last part."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_planted_groups_are_found_where_they_are_not_the_least_cut(spark):
    """four rings of heavy links, each linked with the next by so many light ones that cutting rings is cheaper."""
    from tessera.plans.matrix import Matrix
    from tessera.plans.multilevel import partition_graph

    n = 1600
    i = F.col("id")
    inner = spark.range(n).select(i.alias("i"), ((i + 4) % n).alias("j"), F.lit(4.0).alias("v"))
    outer = spark.range(n).filter("id % 4 != 3").select(i.alias("i"), (i + 1).alias("j"), F.lit(1.0).alias("v"))
    got = partition_graph(Matrix(inner.unionByName(outer), n, n), [1.0] * 4, weighted=True, unbroken=4.0)
    assert sorted((r.g, r.n, r.k) for r in got.groupBy((F.col("i") % 4).alias("g")).agg(F.countDistinct("owner").alias("n"), F.count("*").alias("k")).collect()) == [(g, 1, 400) for g in range(4)]
    assert got.select("owner").distinct().count() == 4
    # what no part can hold is broken
    one = Matrix(spark.range(40).selectExpr("id AS i", "(id + 1) % 40 AS j", "4D AS v"), 40, 40)
    sizes = [r["count"] for r in partition_graph(one, [1.0] * 4, weighted=True, unbroken=4.0).groupBy("owner").count().collect()]
    assert sum(sizes) == 40 and len(sizes) == 4 and max(sizes) <= 11


@pytest.mark.parametrize("transposed", [False, True])
def test_a_packed_product_shuffles_no_entries(spark, monkeypatch, transposed):
    """Tiles stay in their buckets; what is shuffled are blocks of the vector."""
    from tessera.plans import sparse
    from tessera.plans.matrix import Matrix
    from tessera.plans.vector import Vector

    monkeypatch.setattr(sparse, "PACKED", 0)
    monkeypatch.setattr(sparse, "PIECE", 7)
    monkeypatch.setattr(sparse, "BLOCK", 16)
    n, m = 90, 61
    rows = spark.range(n * m).select((F.col("id") / m).cast("long").alias("i"), (F.col("id") % m).alias("j"), (F.col("id") * 0.25 - 9).alias("v")).filter("(i * 7 + j * 5) % 11 < 3 AND i NOT IN (0, 40, 89)")
    dense = np.zeros((n, m))
    for r in rows.collect():
        dense[r.i, r.j] = r.v
    dense = dense.T if transposed else dense
    held = sparse.Held.of(Matrix(rows, n, m))
    x, y = np.arange(dense.shape[1]) % 7 - 2.5, np.arange(dense.shape[0]) % 3.0
    vector = lambda v: Vector(spark.createDataFrame([(k, float(a)) for k, a in enumerate(v)], "i long, v double"), len(v))
    sums = held.sums(vector(x).df, transposed)
    got = np.zeros(dense.shape[0])
    for r in sums.collect():
        got[r.i] += r.v
    assert np.allclose(got, dense @ x)
    found = held.times(vector(x), 2.0, vector(y), -1.0, transposed).df.orderBy("i").collect()
    assert np.allclose([r.v for r in found], 2 * dense @ x - y)
    plan = sums._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "rows" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 2  # values to blocks, blocks to ranges of rows


def test_operators_and_solvers_hold_their_matrix_once(spark, monkeypatch):
    """terms that are matrices become one, and a solver within a solver packs nothing again."""
    from tessera.operators.linear import Of, Shift, gramian
    from tessera.operators.solvers import by_solver, iterations, residual_below, solve
    from tessera.plans import sparse
    from tessera.plans.matrix import Matrix
    from tessera.plans.vector import Vector

    monkeypatch.setattr(sparse, "PACKED", 0)
    packed, tiles = [], sparse.Held._tiles
    monkeypatch.setattr(sparse.Held, "_tiles", lambda self, t: packed.append(t) or tiles(self, t))
    n = 12
    a = np.eye(n) * 5 + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    m = Matrix(spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v double"), n, n)
    x = Vector(spark.createDataFrame([(k, float(k % 3)) for k in range(n)], "i long, v double"), n)
    values = lambda v: [r.v for r in v.df.orderBy("i").collect()]
    assert np.allclose(values((Of(m) - 0.25 * Of(m) + Shift(n, 2.0)).solver_operator().product(x)), (0.75 * a + 2 * np.eye(n)) @ values(x))
    assert packed == [False]
    assert np.allclose(values((gramian(m) + Shift(n, 2.0)).solver_operator().product(x)), (a.T @ a + 2 * np.eye(n)) @ values(x))
    assert sorted(packed[1:]) == [False, True]
    packed.clear()
    got = solve(m, m.times(x), "cg", stop=residual_below(1e-9, relative=True) | iterations(20), preconditioner=by_solver("jacobi", 2, omega=0.9)).x
    assert np.allclose(values(got), values(x)) and packed == [False]


@pytest.mark.parametrize("hot", [3, 1 << 16])
def test_products_of_neighbouring_indexes_are_made_in_one_task(spark, hot):
    """pairs are made after the shuffle, by region of the inner index, also those of indexes with many entries."""
    from tessera.plans.matrix import Matrix

    rows = spark.range(40 * 9).selectExpr("id div 9 AS i", "id % 9 AS j", "id * 0.5D - 7 AS v").filter("i % 5 = 2 OR (i * 3 + j * 5) % 7 < 2")
    dense = np.zeros((40, 9))
    for r in rows.collect():
        dense[r.i, r.j] = r.v
    m = Matrix(rows, 40, 9)
    product = m.transpose().matmul(m, hot=hot).df
    got = np.zeros((9, 9))
    for r in product.collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, dense.T @ dense)
    plan = product._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.index("Generate") < plan.index("REPARTITION_BY_NUM") < plan.index("SortMergeJoin")
