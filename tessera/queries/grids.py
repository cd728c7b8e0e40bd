"""Grids, stencils, sections and images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators.applications import mandelbrot
from tessera.plans.blocks import Blocks, conjugate_gradients
from tessera.plans.grid import Grid, Stencil, apply_stencil, poisson, put_section, reduce_dim, section, stencil_matrix
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables, matrix_out, vector_out
from tessera.sources.binary import false_colours

R = Registry()
T = Tables


def _grid_sql(*shape: int, reach: int) -> str:
    """Places of a grid and their neighbours at most reach steps away."""
    k = len(shape)
    axes = "xyz"[:k]
    cells = f"(SELECT {', '.join(axes)} FROM {', '.join(f'range({n}) r{a}({a})' for n, a in zip(shape, axes))})"
    pos = lambda t: " + ".join(f"{t}.{a} * {__import__('math').prod(shape[m + 1:])}" for m, a in enumerate(axes))
    steps = " + ".join(f"abs(a.{x} - b.{x})" for x in axes)
    near = " AND ".join(f"abs(a.{x} - b.{x}) <= 1" for x in axes)
    points = sum(1 for o in __import__("itertools").product((-1, 0, 1), repeat=k) if 0 < sum(map(abs, o)) <= reach)
    return f"SELECT {pos('a')} AS i, {pos('b')} AS j, CASE WHEN {steps} = 0 THEN {points}.0 ELSE -1.0 END::DOUBLE AS v FROM {cells} a JOIN {cells} b ON {near} AND {steps} <= {reach}"


for _name, _dim, _points, _shape, _reach in (("1d3p", 1, 3, (60,), 1), ("2d5p", 2, 5, (9, 7), 1), ("2d9p", 2, 9, (9, 7), 2), ("3d7p", 3, 7, (5, 4, 6), 1), ("3d19p", 3, 19, (5, 4, 6), 2), ("3d27p", 3, 27, (5, 4, 6), 3)):
    R.add(f"g10_poisson_{_name}", lambda s, d, a=(_dim, _points, *_shape): matrix_out(poisson(s, *a)), _grid_sql(*_shape, reach=_reach))
R.add(
    "g12_periodic_stencil_matrix",
    lambda s, d: matrix_out(stencil_matrix(s, Grid((40,), (True,)), Stencil((((0,), 3.0), ((1,), -1.0), ((-2,), 0.5))))),
    "SELECT i, (i + o + 40) % 40 AS j, w::DOUBLE AS v FROM range(40) r(i), (VALUES (0, 3.0), (1, -1.0), (-2, 0.5)) p(o, w)",
)


def _field(s, d) -> tuple[Vector, Grid]:
    """The trade of nations as a grid."""
    c = T(s, d).c
    return Vector(c.df.select((F.col("i") * 25 + F.col("j")).alias("i"), "v"), 625, 0.0, False).to_dense(), Grid((25, 25))


_F = "(SELECT a.k AS x, b.k AS y, coalesce(c.v, 0) AS v FROM range(25) a(k), range(25) b(k) LEFT JOIN c ON c.i = a.k AND c.j = b.k)"
R.add("l16_stencil_gemv", lambda s, d: vector_out(apply_stencil(*_field(s, d), Stencil.laplace(2, 5))), f"SELECT f.x * 25 + f.y AS i, round(4 * f.v - coalesce(sum(g.v), 0), 4) AS v FROM {_F} f LEFT JOIN {_F.replace('c.v', 'c2.v').replace('c.i', 'c2.i').replace('c.j', 'c2.j').replace('JOIN c ', 'JOIN c c2 ')} g ON abs(f.x - g.x) + abs(f.y - g.y) = 1 GROUP BY f.x, f.y, f.v")
R.add("l21_grid_reduce", lambda s, d: vector_out(reduce_dim(*_field(s, d), 1, "max")[0]), f"SELECT f.x AS i, round(max(f.v), 4) AS v FROM {_F} f GROUP BY f.x")
R.add("l21_grid_diagonal", lambda s, d: vector_out(Vector(_field(s, d)[0].df.select("i", F.when(F.floor(F.col("i") / 25) == F.col("i") % 25, F.lit(9.0)).otherwise(F.col("v")).alias("v")), 625)), f"SELECT f.x * 25 + f.y AS i, round(CASE WHEN f.x = f.y THEN 9 ELSE f.v END, 4) AS v FROM {_F} f")
R.add("l22_section", lambda s, d: vector_out(section(*_field(s, d), [(1, 20, 3), (0, 25, 2)])[0]), f"SELECT (f.x - 1) // 3 * 13 + f.y // 2 AS i, round(f.v, 4) AS v FROM {_F} f WHERE f.x >= 1 AND f.x < 20 AND (f.x - 1) % 3 = 0 AND f.y % 2 = 0")
R.add("l22_section_scalar", lambda s, d: vector_out(put_section(*_field(s, d), [(1, 20, 3), (0, 25, 2)], 2.0, "mult")), f"SELECT f.x * 25 + f.y AS i, round(CASE WHEN f.x >= 1 AND f.x < 20 AND (f.x - 1) % 3 = 0 AND f.y % 2 = 0 THEN 2 * f.v ELSE f.v END, 4) AS v FROM {_F} f")


@R.query("l22_section_of_section", f"SELECT f.x * 25 + f.y AS i, round(f.v + CASE WHEN f.x < 5 AND f.y < 5 THEN f.x * 5 + f.y ELSE 0 END, 4) AS v FROM {_F} f")
def _(s, d):
    return vector_out(put_section(*_field(s, d), [(0, 5, 1), (0, 5, 1)], Vector.linear(s, 25), "add"))


R.add("io11_false_colours", lambda s, d: vector_out(false_colours(*_field(s, d), 0.0, 20.0)[0], 0), f"SELECT (f.x * 25 + f.y) * 3 + k AS i, round(255 * greatest(0, 1 - abs(greatest(0, least(1, f.v / 20.0)) - (2 - k) / 2) * 2), 0)::DOUBLE AS v FROM {_F} f, range(3) r(k)")


@R.query("v20_convolution", f"SELECT f.x * 25 + f.y AS i, round(sum(g.v) / 9, 4) AS v FROM {_F} f JOIN {_F.replace('c.v', 'c2.v').replace('c.i', 'c2.i').replace('c.j', 'c2.j').replace('JOIN c ', 'JOIN c c2 ')} g ON abs(f.x - g.x) <= 1 AND abs(f.y - g.y) <= 1 GROUP BY f.x, f.y")
def _(s, d):
    blur = Stencil(tuple(((a, b), 1 / 9) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return vector_out(apply_stencil(*_field(s, d), blur))


def _orders(s, d, *folded: int) -> Blocks:
    """The total prices of orders, in the order of their keys, on a grid with rows (or layers of rows) of a fixed size, in blocks."""
    x = T(s, d).x
    layer = math.prod(folded)
    return Blocks.pack(x, Grid((-(-x.n // layer), *folded)), (64,) * (1 + len(folded)) if len(folded) < 2 else (16, 16, 16)).keep()


def _around_sql(folded: tuple[int, ...], points: list[tuple[tuple[int, ...], str]], x: str = "x") -> str:
    """Weighted neighbours of each place of the grid of orders; those that leave a row, a layer or the grid are left out."""
    layer = math.prod(folded)
    widths = [math.prod(folded[k:]) for k in range(len(folded))] + [1]
    at = lambda k: f"i // {widths[k]}" if k == 0 else f"i // {widths[k]} % {folded[k - 1]}"
    sent = []
    for o, w in points:
        inside = " AND ".join(f"{at(k)} - ({o[k]}) BETWEEN 0 AND {folded[k - 1] - 1}" for k in range(1, len(o)) if o[k]) or "true"
        sent.append(f"SELECT i - ({sum(a * b for a, b in zip(o, widths))}) AS i, {w} * v AS v FROM {x} WHERE {inside}")
    places = f"(SELECT (max(o_orderkey) + {layer}) // {layer} * {layer} AS n FROM orders)"
    every = f"SELECT unnest(range(n)) AS i, 0.0 AS v FROM {places}"
    return f"SELECT i, sum(v) AS v FROM ({' UNION ALL '.join([every, *sent])}) WHERE i >= 0 AND i < (SELECT n FROM {places}) GROUP BY i"


_STAR = [(o, str(w)) for o, w in Stencil.laplace(2, 5).points]
_STAR3 = [(o, str(w)) for o, w in Stencil.laplace(3, 7).points]
_BLUR = [((a, b), "(1.0 / 9)::DOUBLE") for a in (-1, 0, 1) for b in (-1, 0, 1)]
_FIRM = Stencil(tuple((o, w if any(o) else 12.0) for o, w in Stencil.laplace(2, 5).points))
R.add("l16_stencil_blocks", lambda s, d: vector_out(_orders(s, d, 128).stencil(Stencil.laplace(2, 5)).unpack(), 3), f"SELECT i, round(v, 3) AS v FROM ({_around_sql((128,), _STAR)})")
R.add("j18_stencil_blocks", lambda s, d: vector_out(_orders(s, d, 16, 16).stencil(Stencil.laplace(3, 7)).unpack(), 3), f"SELECT i, round(v, 3) AS v FROM ({_around_sql((16, 16), _STAR3)})")




def _rows_of_orders(s, d) -> tuple[Vector, Grid]:
    """The total prices of orders as a grid with 128 a row."""
    x = T(s, d).x
    return x, Grid((-(-x.n // 128), 128))


_PART_OF = "x.i // 128 >= 1 AND (x.i // 128 - 1) % 3 = 0 AND x.i % 128 < 125 AND x.i % 2 = 0"


def _some(grid: Grid) -> list[tuple[int, int, int]]:
    return [(1, grid.shape[0], 3), (0, 125, 2)]


@R.query("l22_section_of_orders", f"SELECT (x.i // 128 - 1) // 3 * 63 + x.i % 128 // 2 AS i, round(x.v, 4) AS v FROM x WHERE {_PART_OF}")
def _(s, d):
    x, grid = _rows_of_orders(s, d)
    return vector_out(section(x, grid, _some(grid))[0])


@R.query("l22_section_scalar_of_orders", f"SELECT x.i, round(CASE WHEN {_PART_OF} THEN 2 * x.v ELSE x.v END, 4) AS v FROM x")
def _(s, d):
    x, grid = _rows_of_orders(s, d)
    return vector_out(put_section(x, grid, _some(grid), 2.0, "mult"))


for _dim, _by in ((0, "i % 128"), (1, "i // 128")):
    R.add(f"l21_reduce_of_orders_{_dim}", lambda s, d, k=_dim: vector_out(reduce_dim(*_rows_of_orders(s, d), k, "max")[0]), f"SELECT {_by} AS i, round(max(v), 4) AS v FROM x GROUP BY 1")


@R.query("v20_convolution_blocks", f"SELECT i, round(v, 3) AS v FROM ({_around_sql((128,), _BLUR, '(' + _around_sql((128,), _BLUR) + ')')})")
def _(s, d):
    """Prices blurred twice: each step sends the faces of blocks."""
    blur = Stencil(tuple(((a, b), 1 / 9) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return vector_out(_orders(s, d, 128).steps(blur, 2).unpack(), 3)


@R.query("v01_cg_blocks", "SELECT o_orderkey AS i, (o_orderkey % 5 + 1)::DOUBLE AS v FROM orders")
def _(s, d):
    """A system of a stencil over the grid of orders, whose solution is known."""
    known = Vector.of(T(s, d).table("orders"), "o_orderkey", F.col("o_orderkey") % 5 + 1, T(s, d).size("orders", "o_orderkey"))
    right = Blocks.pack(known, Grid((-(-known.n // 128), 128)), (64, 64)).keep().stencil(_FIRM)
    x, _norms = conjugate_gradients(_FIRM, right, eps=1e-7)
    rows = vector_out(x.unpack(), 3)
    return rows.filter("v != 0")


@R.query(
    "v20_mandelbrot",
    "WITH RECURSIVE m(i, cx, cy, x, y, k) AS (SELECT r * 40 + q, -2.0 + q * 0.075, -1.0 + r * 0.1, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM range(20) a(r), range(40) b(q) UNION ALL SELECT i, cx, cy, x * x - y * y + cx, 2 * x * y + cy, k + 1 FROM m WHERE x * x + y * y <= 4 AND k < 30) SELECT i, max(k)::DOUBLE AS v FROM m GROUP BY i",
)
def _(s, d):
    return vector_out(mandelbrot(s, 40, 20, 30)[0])
