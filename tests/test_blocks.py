"""Grids as blocks that send faces, against numpy and against the form without blocks."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tessera.plans.blocks import Blocks, conjugate_gradients, sides
from tessera.plans.grid import Grid, Stencil, apply_stencil
from tessera.plans.vector import Vector


def field(spark, values: np.ndarray) -> Vector:
    return Vector(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values.ravel())], "i long, v double"), values.size)


def held(x: Vector) -> np.ndarray:
    out = np.full(x.n, np.nan)
    for i, v in x.df.collect():
        assert np.isnan(out[i])
        out[i] = v
    return out


def by_hand(a: np.ndarray, wraps, points) -> np.ndarray:
    out = np.zeros(a.shape)
    for at in itertools.product(*map(range, a.shape)):
        for offset, w in points:
            to = [x + o for x, o in zip(at, offset)]
            to = [t % n if wrap else t for t, n, wrap in zip(to, a.shape, wraps)]
            if all(0 <= t < n for t, n in zip(to, a.shape)):
                out[at] += w * a[tuple(to)]
    return out


STAR = Stencil.laplace(2, 5)
BOX = Stencil.laplace(3, 27)
LOPSIDED = Stencil((((0, 0), 2.0), ((3, -1), 0.5), ((0, 4), -1.5), ((-2, 2), 0.25)))
CASES = [
    ((17,), (5,), (), Stencil((((0,), 1.0), ((-7,), 2.0), ((6,), -1.0)))),
    ((17,), (5,), (True,), Stencil((((0,), 1.0), ((-20,), 2.0), ((19,), -1.0)))),
    ((9, 7), (4, 3), (), STAR),
    ((9, 7), (4, 3), (True, False), LOPSIDED),
    ((9, 7), (1, 2), (True, True), LOPSIDED),
    ((9, 7), (9, 7), (True, True), LOPSIDED),
    ((5, 4, 6), (2, 3, 4), (False, True, False), BOX),
    ((3, 4, 2, 3), (2, 2, 2, 2), (False, False, True, True), Stencil((((0, 0, 0, 0), 1.0), ((1, 0, -1, 0), 2.0), ((0, -1, 0, 2), 3.0)))),
]


@pytest.mark.parametrize("shape,side,wraps,stencil", CASES)
def test_stencils_agree_with_loops(spark, shape, side, wraps, stencil):
    a = np.random.default_rng(5).normal(size=shape)
    grid = Grid(shape, wraps)
    x = field(spark, a)
    got = Blocks.pack(x, grid, side).stencil(stencil).unpack()
    want = by_hand(a, wraps or (False,) * len(shape), stencil.points).ravel()
    assert np.allclose(held(got), want)
    assert np.allclose(held(apply_stencil(x, grid, stencil)), want)


def test_blocks_hold_what_the_vector_does(spark):
    x = Vector(spark.createDataFrame([(0, 1.0), (6, None), (11, 3.0), (34, -2.0)], "i long, v double"), 35, 0.0, False)
    want = np.zeros(35)
    want[[0, 11, 34]] = 1, 3, -2
    packed = Blocks.pack(x, Grid((5, 7)), (2, 3))
    assert packed.df.count() == packed.count == 9
    assert np.array_equal(held(packed.unpack()), want)
    none = Vector(x.df.limit(0), 35, 0.0, False)
    assert np.array_equal(held(Blocks.pack(none, Grid((5, 7)), (2, 3)).stencil(STAR).unpack()), np.zeros(35))
    with pytest.raises(ValueError):
        Blocks.pack(x, Grid((5, 6)))
    with pytest.raises(ValueError):
        Blocks.pack(x, Grid((5, 7)), (2,))


def test_sides_fill_a_block():
    assert sides(Grid((10**6,))) == (65_536,)
    assert sides(Grid((10**4, 10**4))) == (256, 256)
    assert sides(Grid((10**6, 64))) == (1024, 64)
    assert sides(Grid((3, 2))) == (3, 2)


def test_only_faces_are_shuffled(spark):
    a = np.random.default_rng(6).normal(size=(40, 40))
    kept = Blocks.pack(field(spark, a), Grid((40, 40)), (10, 10)).keep()
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = plan_of(kept.stencil(STAR).df)
    assert plan.count("Exchange") == 1 and "Exchange" in plan.split("collect_list")[1] and "Bucketed: false" not in plan
    files = kept.stencil(STAR).keep().df.inputFiles()
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task wrote its own buckets alone
    sizes = kept.faces(STAR).selectExpr("sum(length(face)) / 8", "count(*)").first()
    assert sizes[0] == 24 * 10 * 2 and sizes[1] == 48  # 24 edges between blocks, 10 values each way
    assert plan_of(kept.combine(lambda x, y: x - y, kept).df).count("Exchange") == 0


def test_steps_and_places(spark):
    a = np.random.default_rng(7).normal(size=(9, 7))
    blocks = Blocks.pack(field(spark, a), Grid((9, 7)), (4, 3))
    want = a
    for _ in range(3):
        want = by_hand(want, (False, False), STAR.points)
    assert np.allclose(held(blocks.steps(STAR, 3).unpack()), want.ravel())
    assert np.allclose(held(blocks.combine(lambda x, y: x * y + 1, blocks).unpack()), (a * a + 1).ravel())
    assert np.isclose(blocks.fold(lambda x: float(x.sum())).first()[0], a.sum())


def test_conjugate_gradients_over_blocks(spark):
    want = np.random.default_rng(8).integers(0, 5, (8, 6)).astype(float)
    firm = Stencil(tuple((o, 12.0 if not any(o) else w) for o, w in STAR.points))
    right = Blocks.pack(field(spark, by_hand(want, (False, False), firm.points)), Grid((8, 6)), (4, 4))
    x, norms = conjugate_gradients(firm, right, eps=1e-7)
    assert np.allclose(held(x.unpack()), want.ravel(), atol=1e-4) and norms[-1] <= 1e-7 * norms[0]
    zero = right.combine(np.zeros_like)
    assert not held(conjugate_gradients(firm, zero)[0].unpack()).any()
    with pytest.raises(ValueError):
        conjugate_gradients(Stencil((((0, 0), -1.0),)), right)
