"""What the third review found, its rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.plans.grid import Grid, Stencil, stencil_matrix
from tessera.plans.matrix import Matrix
from tessera.plans.storage import cut
from tessera.plans.vector import Vector


def dense(df, n, m):
    made = np.zeros((n, m))
    for r in df.collect():
        made[r.i, r.j] += r.v
    return made


def test_a_cycle_is_two_products_a_level_and_small_levels_are_one_task(spark, monkeypatch):
    """S b + Q e is the V-cycle with a sweep down and one up, with small levels in a task or not."""
    from tessera.operators import multigrid as mg

    n = 100
    rows = stencil_matrix(spark, Grid((10, 10)), Stencil.laplace(2, 5)).df.selectExpr(f"(i * 7919) % {n} AS i", f"(j * 7919) % {n} AS j", "v")
    a = Matrix(cut(rows), n, n)
    b = Vector(cut(spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7 - 2.5).alias("v"))), n)
    whole = mg.hierarchy(a, coarsest=8, gathered=0)
    split = mg._with_small(whole.levels, whole.last, mg.GATHERED)
    assert whole.gathered is None and split.gathered == 1 and whole.sizes == split.sizes and len(whole.sizes) > 2
    x = [np.array([r.v for r in h.cycle(b).df.orderBy("i").collect()]) for h in (whole, split)]
    assert np.allclose(x[0], x[1])

    # the cycle step by step, P being found from Q = (1 - w D^-1 A) P
    def cycle(v, at):
        level = whole.levels[at]
        m = dense(level.a.df, level.a.n, level.a.n)
        if level.cycle is None:
            return np.linalg.solve(m, v)
        d = np.diag(m)
        q = dense(level.cycle.df, level.a.n, level.cycle.m)[:, level.a.n :]
        p = np.linalg.solve(np.eye(level.a.n) - mg.OMEGA * m / d[:, None], q)
        y = mg.OMEGA * v / d
        y = y + p @ cycle(p.T @ (v - m @ y), at + 1)
        return y + mg.OMEGA * (v - m @ y) / d

    assert np.allclose(x[0], cycle(np.arange(n) % 7 - 2.5, 0))
    written = []
    monkeypatch.setattr(mg, "cut", lambda df: written.append(1) or cut(df))
    split.cycle(b)
    assert len(written) == 2
    split.release()


def test_a_product_with_many_vectors_holds_the_sums_of_a_range_of_rows(spark, monkeypatch):
    """tiles meet blocks of all vectors; values that aren't there make no sums, those that cancel do."""
    from tessera.plans import matrix, sparse

    monkeypatch.setattr(matrix, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(sparse, "BLOCK", 16)
    monkeypatch.setattr(sparse, "PIECE", 9)
    n, m = 83, 50
    rows = spark.range(n * m).selectExpr(f"id div {m} AS i", f"id % {m} AS j", "id * 0.25D - 9 AS v").filter("(i * 7 + j * 5) % 11 < 2 AND i NOT IN (0, 40)")
    others = spark.range(m * 3).selectExpr("id div 3 AS i", "id % 3 * 5 - 2 AS k", "id % 8 - 3D AS v").filter("(i + k) % 4 != 0")
    got = matrix.Matrix(rows, n, m).times_many(others)
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString() and "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = rows.join(others.select(F.col("i").alias("j"), "k", F.col("v").alias("y")), "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("y")).alias("v"))
    found, expected = ({(r.i, r.k): r.v for r in df.collect()} for df in (got, want))
    assert got.count() == len(found) and found.keys() == expected.keys()
    assert all(abs(found[key] - v) < 1e-9 for key, v in expected.items())
