"""Arithmetic notation and linear operators against numpy, and the plans they make."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tessera.operators.linear import Of, OnGrid, Shift, gramian
from tessera.operators.solvers import bicgstab, cg, diagonal, iterations, qmr, residual_below
from tessera.plans.grid import Grid, Stencil, apply_stencil, stencil_matrix
from tessera.plans.matrix import Matrix
from tessera.plans.storage import cut
from tessera.plans.vector import Vector

RNG = np.random.default_rng(11)
N = 12
A, B = (np.where(RNG.random((N, N)) < 0.4, RNG.normal(size=(N, N)), 0.0) for _ in range(2))
X, Y, Z = (RNG.normal(size=N) for _ in range(3))


def mat(spark, a):
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return Matrix(cut(spark.createDataFrame(rows, "i long, j long, v double")), *a.shape)


def vec(spark, x, **how):
    return Vector(cut(spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double")), len(x), **how)


def values(x):
    return np.array([r.v for r in x.to_dense().df.orderBy("i").collect()])


def dense(a):
    out = np.zeros((a.n, a.m))
    for r in a.df.collect():
        out[r.i, r.j] += r.v
    return out


@pytest.fixture(scope="module")
def held(spark):
    return mat(spark, A), mat(spark, B), vec(spark, X), vec(spark, Y), vec(spark, Z)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan)), len(re.findall(r"Join", plan))


def test_sums_are_one_union_and_one_aggregate(held):
    _, _, x, y, z = held
    e = 2 * x + 3 * y - z / 4 + x
    assert np.allclose(values(e.value), 3 * X + 3 * Y - Z / 4)
    assert len(e.terms) == 3 and exchanges(e.df) == (1, 0)
    assert exchanges((2 * x).df) == (0, 0) and exchanges((x - x + 5 * y).df) == (0, 0)


def test_chains_of_places_are_one_projection(held):
    _, _, x, _, _ = held
    e = 2 * abs(x) ** 2.0 / 3
    assert np.allclose(values(e.value), 2 * X**2 / 3) and exchanges(e.df) == (0, 0)
    assert np.allclose(values((1 - x).value if hasattr(1 - x, "value") else 1 - x), 1 - X)
    assert np.allclose(values(x * held[3]), X * Y) and np.allclose(values(1 / x), 1 / X)


def test_products_are_terms(held):
    a, b, x, y, _ = held
    e = 2 * (a @ x) - (a + b) @ y / 2 + y
    assert np.allclose(values(e.value), 2 * A @ X - (A + B) @ Y / 2 + Y)
    assert np.allclose(dense((2 * a - b / 2 + a).value), 3 * A - B / 2)
    assert np.allclose(dense(((a + b) @ (a - b)).value), (A + B) @ (A - B))
    with pytest.raises(ValueError):
        x + Vector(x.df, N + 1)
    with pytest.raises(TypeError):
        x + "y"


def test_sparse_vectors_keep_their_implicit_values(spark):
    rows = spark.createDataFrame([(1, 5.0)], "i long, v double")
    x, y = Vector(rows, 4, 2.0, False), Vector(rows.selectExpr("i + 1 AS i", "v"), 4, -1.0, False)
    e = (3 * x - y).value
    assert not e.dense and e.zero == 7.0 and values(e).tolist() == [7, 16, 1, 7]


GRID, STENCIL = Grid((3, 4)), Stencil((((0, 0), 4.0), ((0, 1), -1.0), ((-1, 0), 0.5)))


def test_operators_are_what_their_matrices_are(spark, held):
    a, b, x, _, _ = held
    g = np.zeros((N, N))
    for r in stencil_matrix(spark, GRID, STENCIL).df.collect():
        g[r.i, r.j] = r.v
    on = OnGrid(GRID, STENCIL)
    cases = {
        "sum": (Of(a) + 2.0 * Of(b) - Shift(N, 3.0), A + 2 * B - 3 * np.eye(N)),
        "chain": (Of(a) @ Of(b).T, A @ B.T),
        "gramian": (gramian(a) + Shift(N, 1.0), A.T @ A + np.eye(N)),
        "grid": (on + Of(a), g + A),
        "scaled": (-(0.5 * (on + Of(a) @ Of(b))), -0.5 * (g + A @ B)),
    }
    for name, (op, want) in cases.items():
        assert np.allclose(values(op @ x), want @ X), name
        assert np.allclose(values(op.T @ x), want.T @ X), name
    assert np.allclose(values(apply_stencil(x, GRID, STENCIL)), g @ X)
    joins = exchanges((Of(a) + Of(b) + Shift(N, 2.0)).apply(x).df)[1]
    assert joins == 1
    d = cases["gramian"][0].solver_operator(with_diagonal=True).diagonal
    assert np.allclose(values(d), np.diag(A.T @ A) + 1)
    with pytest.raises(ValueError):
        Of(a) + Shift(N + 1)


def test_solvers_take_operators(spark, held):
    a, _, x, _, _ = held
    stop = residual_below(1e-9, relative=True) | iterations(60)
    spd = gramian(a) + Shift(N, 2.0)
    b = Vector(cut(spd.apply(x).df), N)
    assert np.allclose(values(cg(spd.solver_operator(with_diagonal=True), b, stop=stop, preconditioner=diagonal).x), X, atol=1e-6)
    skew = 0.2 * Of(a) + Shift(N, 3.0)
    b = Vector(cut(skew.apply(x).df), N)
    for method in (bicgstab, qmr):
        assert np.allclose(values(method(skew.solver_operator(), b, stop=stop).x), X, atol=1e-5)
