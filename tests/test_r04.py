"""What the fourth review found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import factor
from tests.test_tiles import dense, matrix, values, vector


def linked(rng, sizes, symmetric):
    """A matrix of components of these sizes, its unknowns in random order."""
    n = sum(sizes)
    a, at = np.zeros((n, n)), 0
    for size in sizes:
        block = rng.normal(size=(size, size)) * (rng.random((size, size)) < 0.6)
        block = (block + block.T if symmetric else block) + 8 * np.eye(size)
        a[at : at + size, at : at + size], at = block, at + size
    order = rng.permutation(n)
    return a[np.ix_(order, order)]


def test_components_are_factorised_side_by_side(spark, monkeypatch):
    """a step takes a panel of each bin of components; no tile between bins is made."""
    monkeypatch.setattr(factor, "BINNED", 8)
    rng = np.random.default_rng(5)
    sizes = [9, 9, 7, 1, 2]
    for symmetric in (False, True):
        a = linked(rng, sizes, symmetric)
        f = factor.factorize(matrix(spark, a), symmetric, size=4)
        assert f.period == 3 and f.n == len(a) and f.place.select("p").distinct().count() == len(a)
        assert f.lower.df.unionByName(f.upper.df).filter("bi div 3 != bj div 3").isEmpty()
        x = rng.normal(size=len(a))
        assert np.allclose(values(f.solve(vector(spark, a @ x))), x)
    assert np.allclose(dense(f.inverse()) @ a, np.eye(len(a)))


def test_tiles_of_zeros_are_filled_in(spark):
    """an inverse of components has no tiles between them, the identity's places are all in the result."""
    from tessera.plans.tiles import Tiles

    a = np.diag(np.arange(1.0, 8.0))
    got = Tiles.pack(matrix(spark, a), 3).filled().entries().df
    assert got.count() == 49 and got.agg(F.sum("v")).first()[0] == 28


def test_products_of_large_matrices_are_summed_in_regions(spark, monkeypatch):
    """entries go to their region as they are, pieces of tiles to their tile; neither pairs nor rows of sums are shuffled."""
    from tessera.plans import complex as complex_plans
    from tessera.plans import products
    from tessera.plans.complex import ComplexMatrix
    from tessera.plans.matrix import Matrix

    monkeypatch.setattr(products, "LEAST", 1)
    monkeypatch.setattr(complex_plans, "HOT_INNER", 3)
    rows = spark.range(40 * 9).selectExpr("id div 9 AS i", "id % 9 AS j", "id % 17 - 7D AS re", "id % 5 - 2D AS im").filter("i % 5 = 2 OR (i * 3 + j * 5) % 7 < 2")
    a = np.zeros((40, 9), complex)
    for r in rows.collect():
        a[r.i, r.j] = complex(r.re, r.im)
    m = ComplexMatrix(rows, 40, 9)
    got, product = np.zeros((9, 9), complex), m.matmul(m, "conj_transpose").df
    plan = product._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Generate" not in plan.split("MapInArrow")[1]
    for r in product.collect():
        got[r.i, r.j] += complex(r.re, r.im)
    assert np.allclose(got, a.conj().T @ a) and product.count() == 81
    re = Matrix(rows.select("i", "j", F.col("re").alias("v")), 40, 9)
    for hot in (3, 1 << 16):
        got = np.zeros((9, 9))
        for r in re.transpose().matmul(re, 0.5, Matrix.identity(spark, 9), 2.0, hot=hot).df.collect():
            got[r.i, r.j] += r.v
        assert np.allclose(got, 0.5 * a.real.T @ a.real + 2 * np.eye(9))


def test_sums_of_regions_are_whole_whatever_is_held(monkeypatch):
    """with few tiles held, few products made at once and batches that cut inner indexes in two."""
    import pyarrow as pa

    from tessera.plans import products

    rng = np.random.default_rng(0)
    a, b = (rng.integers(-3, 4, (40, m)) * (rng.random((40, m)) < 0.4) for m in (9, 11))
    rows = sorted([(k // 10, 0, 0, k, side, j, float(x[k, j])) for side, x in enumerate((a, b)) for k, j in zip(*(v.tolist() for v in np.nonzero(x)))], key=lambda r: r[:4])
    piece = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("at", pa.binary()), ("v", pa.binary())])
    out = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())])
    for held, some, chunk, made, step in ((48, 1, 1 << 20, 1 << 20, 1000), (2, 1, 5, 7, 4), (48, 100, 1, 3, 1), (1, 2, 13, 50, 17)):
        for name, value in {"HELD": held, "SOME": some, "CHUNK": chunk, "MADE": made, "TILE": 4}.items():
            monkeypatch.setattr(products, name, value)
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at : at + step]]) for c in range(7)], names=list("abcdefg")) for at in range(0, len(rows), step)]
        pieces = pa.Table.from_batches(products._pieces(products.real, 1, piece)(iter(batches))).sort_by([("bi", "ascending"), ("bj", "ascending")])
        whole = pa.Table.from_batches(products._whole(1, out)(iter(pieces.to_batches())))
        got = np.zeros((9, 11))
        got[whole["i"].to_numpy(), whole["j"].to_numpy()] = whole["v"].to_numpy()
        assert np.array_equal(got, a.T @ b) and whole.num_rows == (((a != 0).astype(int).T @ (b != 0)) > 0).sum()


def test_sweeps_of_triangular_systems_are_chained(spark, monkeypatch):
    """no round is made where most rows need several others; CHAINED sweeps are one written table."""
    from tessera.operators import triangular as tri

    rng = np.random.default_rng(5)
    n = 60
    a = np.tril(np.where(rng.random((n, n)) < 0.4, rng.normal(size=(n, n)), 0.0), -1)
    a += np.diag(np.abs(a).sum(axis=1) * 2 + 1)
    x = rng.normal(size=n)
    monkeypatch.setattr(tri, "_round", lambda *_: (_ for _ in ()).throw(AssertionError("a round was made")))
    written = []
    monkeypatch.setattr(tri, "cut", lambda df: written.append(1) or factor.cut(df))
    for most in (1 << 18, 0):
        monkeypatch.setattr(tri, "BROADCAST_ROWS", most)
        written.clear()
        got, rounds = tri.triangular(matrix(spark, a), vector(spark, a @ x), worth=0.5)
        assert np.allclose(values(got), x, rtol=1e-12) and rounds == 0 and len(written) < 4 + 60 // tri.CHAINED


def test_conjugate_gradients_find_their_sums_while_writing(spark, monkeypatch):
    """The sums of a step come with its tables, and are those of the vectors."""
    from tessera.operators import solvers

    rng = np.random.default_rng(2)
    n = 12
    a = rng.normal(size=(n, n))
    a = a @ a.T / n + np.diag(np.arange(1.0, n + 1))
    x = rng.normal(size=n)
    m, b = matrix(spark, a), vector(spark, a @ x)
    added = []
    sums = solvers.State.sums
    monkeypatch.setattr(solvers.State, "sums", lambda self, **v: added.append(1) or sums(self, **v))
    two = lambda s, to, of: s.let(**{to: of * 0.5})
    for options, most in (({}, 1), ({"jacobi": True}, 1), ({"preconditioner": solvers.by_solver("jacobi", 1)}, 13), ({"preconditioner": two}, 6)):
        added.clear()
        got = solvers.cg(m, b, stop=solvers.iterations(5), **options)
        assert len(added) <= most, "the first residual's, and those of a solver within or of a preconditioner that writes nothing"
        ax = a @ values(got.x)
        assert np.isclose(got.residuals[-1], np.linalg.norm(a @ x - ax), rtol=1e-6)
