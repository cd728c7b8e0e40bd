"""Tiled products and factors against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import factor
from tessera.plans.matrix import Matrix
from tessera.plans.tiles import Tiles
from tessera.plans.vector import Vector


def matrix(spark, a):
    rows = [(i, j, float(a[i, j])) for i, j in zip(*map(lambda x: x.tolist(), np.nonzero(a)))]
    return Matrix(spark.createDataFrame(rows, "i long, j long, v double"), *a.shape)


def vector(spark, x):
    return Vector(spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double"), len(x))


def dense(t):
    out = np.zeros((t.n, t.m))
    for r in t.entries().df.collect():
        out[r.i, r.j] = r.v
    return out


def values(x):
    return np.array([r.v for r in x.df.orderBy("i").collect()])


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(3)


def test_tiles_hold_what_the_triples_do(spark, rng):
    a = np.where(rng.random((13, 22)) < 0.2, rng.normal(size=(13, 22)), 0.0)
    m = matrix(spark, a)
    for full in (False, True):
        assert np.array_equal(dense(Tiles.pack(m, 5, full)), a)
        assert np.array_equal(dense(Tiles.pack(m, 5, full).transpose()), a.T)
    rows = spark.createDataFrame([(i, a[i].tolist()) for i in range(13)], "i long, v array<double>")
    assert np.array_equal(dense(Tiles.of_rows(rows, "i", "v", 13, 22, 5)), a)


def test_products_and_sums(spark, rng):
    a, b, c = rng.normal(size=(17, 9)), rng.normal(size=(9, 12)), rng.normal(size=(17, 12))
    ta, tb, tc = (Tiles.pack(matrix(spark, x), 4) for x in (a, b, c))
    assert np.allclose(dense(ta.matmul(tb, 2.0, tc, -0.5)), 2 * a @ b - 0.5 * c)
    assert np.allclose(dense(tc.plus(tc, 2.0, -3.0)), -c)
    sparse = np.where(rng.random(b.shape) < 0.3, b, 0.0)
    assert np.allclose(dense(ta.matmul_sparse(matrix(spark, sparse))), a @ sparse)
    for size in (4, 16):
        assert np.allclose(dense(Tiles.pack(matrix(spark, a), size).gramian()), a.T @ a)
    with pytest.raises(ValueError):
        ta.matmul(ta)


def test_products_of_many_tiles_are_handed_on_in_parts(spark, rng, monkeypatch):
    from tessera.plans import tiles

    monkeypatch.setattr(tiles, "HELD", 1000)
    a = rng.normal(size=(20, 20))
    assert np.allclose(dense(Tiles.pack(matrix(spark, a), 3).matmul(Tiles.pack(matrix(spark, a), 3))), a @ a)


@pytest.mark.parametrize("n, size", [(1, 4), (7, 8), (23, 5)])
def test_lu_is_that_of_the_rows_in_pivot_order(spark, rng, n, size):
    a = rng.normal(size=(n, n))
    a[0, 0] = 0 if n > 1 else 2.0
    f = factor.lu(matrix(spark, a), size)
    lower, upper = dense(f.lower), dense(f.upper)
    order = [r.row for r in f.order.orderBy("p").collect()]
    assert np.allclose(lower @ upper, a[order]) and np.allclose(np.triu(upper), upper) and np.allclose(np.diag(lower), 1)
    assert np.abs(lower).max() < 8, "pivoting bounds the lower factor"
    for _ in range(2):
        x = rng.normal(size=n)
        assert np.allclose(values(f.solve(vector(spark, a @ x))), x)
    assert np.allclose(dense(f.inverse()) @ a, np.eye(n))


def test_a_tournament_of_several_rounds_finds_pivots(spark, rng, monkeypatch):
    monkeypatch.setattr(factor, "PLAY", 2)
    a = rng.normal(size=(26, 26)) * (10.0 ** rng.integers(-3, 4, size=(26, 1)))
    x = rng.normal(size=26)
    assert np.allclose(values(factor.lu(matrix(spark, a), 4).solve(vector(spark, a @ x))), x)


def test_ldlt_of_a_symmetric_matrix(spark, rng):
    a = rng.normal(size=(19, 19))
    a = a + a.T + 12 * np.diag(rng.choice([-1.0, 1.0], 19))
    f = factor.factorize(matrix(spark, a), symmetric=True, size=6)
    assert np.allclose(dense(f.lower) @ dense(f.upper), a)
    x = rng.normal(size=19)
    assert np.allclose(values(f.solve(vector(spark, a @ x))), x)


def test_singular_systems_are_errors(spark):
    a = np.ones((9, 9))
    with pytest.raises(ValueError, match="singular"):
        factor.lu(matrix(spark, a), 4)
    with pytest.raises(ValueError, match="singular"):
        factor.ldlt(matrix(spark, a), 4)
