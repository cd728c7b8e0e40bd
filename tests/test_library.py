"""Vectors, matrices, files and solvers on small literal inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import applications as app
from tessera.operators import fft, generate
from tessera.operators.assembly import assemble_matrix, assemble_vector
from tessera.operators.solvers import SOLVERS, Operator, by_solver, decomposition_solve, diagonal, inverse, iterations, residual_below, row_colours, solve, triangular_solve, trivial
from tessera.operators.triangular import triangular
from tessera.plans.complex import ComplexMatrix, ComplexVector
from tessera.plans.grid import Grid, Stencil, apply_stencil, stencil_matrix
from tessera.plans.matrix import Matrix
from tessera.plans.partition import edge_cut, general_block_offsets, proc_grid, weighted_blocks
from tessera.plans.vector import Vector
from tessera.sources import binary, files, text


def vec(spark, values, parts=2):
    return Vector(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "i long, v double").repartition(parts), len(values))


def sparse(spark, entries, n, zero=0.0):
    return Vector(spark.createDataFrame([(k, float(v)) for k, v in entries.items()], "i long, v double"), n, zero, False)


def mat(spark, a):
    a = np.asarray(a, float)
    return Matrix(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]], "i long, j long, v double"), *a.shape)


def values(v):
    out = np.full(v.n, v.zero)
    for r in v.df.collect():
        out[r.i] = r.v
    return out


def dense(m):
    out = np.zeros((m.n, m.m))
    for r in m.df.collect():
        out[r.i, r.j] = r.v
    return out


def test_sort_gather_and_scan(spark):
    for parts in (1, 2, 7):
        x = vec(spark, [5, 9, 4, 8, 1, 2, 3], parts)
        s, p = x.sort()
        assert values(s).tolist() == [1, 2, 3, 4, 5, 8, 9]
        assert values(p).tolist() == [4, 5, 6, 2, 0, 3, 1]
        assert values(x.gather(vec(spark, [3, 4, 1, 0, 6, 2]))).tolist() == [8, 1, 9, 5, 3, 4]
        assert values(vec(spark, range(1, 101), parts).scan()).tolist() == [(k + 1) * (k + 2) / 2 for k in range(100)]
    assert values(vec(spark, [5, 11, 3]).concat(vec(spark, [8, 14]))).tolist() == [5, 11, 3, 8, 14]


def test_scan_over_several_blocks(spark):
    from tessera.plans.scan import prefix_sum

    got = prefix_sum(vec(spark, range(50)).df, block=7).orderBy("i").toPandas()["v"]
    assert got.tolist() == np.cumsum(np.arange(50.0)).tolist()


def test_sparse_operations_keep_their_implicit_value(spark):
    x, y = sparse(spark, {0: 5, 5: 6, 6: 7}, 10, 1.0), sparse(spark, {0: 5, 4: 4, 6: 9}, 10, 1.0)
    for op in ("add", "sub", "mult", "divide", "min", "max", "abs_diff", "pow", "copy_sign", "copy"):
        got = x.binary(op, y)
        want = x.to_dense().binary(op, y.to_dense())
        assert got.df.count() == 4
        assert np.allclose(values(got), values(want)), op
    assert x.sum().first()[0] == 5 + 6 + 7 + 7
    assert x.reduce("min").first()[0] == 1
    assert not x.all_scalar("gt", 1.0).first()[0]
    z = sparse(spark, {}, 4)
    assert z.sum().first()[0] == 0 and z.max_norm().first()[0] == 0


def test_scatter_with_repeated_indexes(spark):
    x, idx, src = vec(spark, [0, 0, 0]), vec(spark, [2, 2, 1]), vec(spark, [5, 6, 7])
    assert values(x.scatter(idx, src, "add")).tolist() == [0, 7, 11]
    assert values(x.scatter(idx, src)).tolist() == [0, 7, 6]


TD1 = np.array([[6, 0, 0, 4], [7, 0, 0, 0], [0, 0, 9, 4], [2, 5, 0, 3], [2, 0, 0, 1], [0, 0, 0, 0], [0, 1, 0, 2]], float)


def test_matrix_operations(spark):
    a, x, y = mat(spark, TD1), vec(spark, [1, 2, 3, 4]), vec(spark, range(7))
    assert np.allclose(values(a.times(x, 2.0, y, -1.0)), 2 * TD1 @ [1, 2, 3, 4] - np.arange(7))
    assert np.allclose(values(a.times(y, transposed=True)), TD1.T @ np.arange(7))
    assert np.allclose(dense(a.transpose().matmul(a)), TD1.T @ TD1)
    assert np.allclose(dense(a.plus(a, 1.0, -0.5)), TD1 / 2)
    assert values(a.reduce(0, "add", "sqr")).tolist() == (TD1**2).sum(axis=1).tolist()
    assert dense(a.append_rows(a)).shape == (14, 4)
    assert values(a.offsets()).tolist() == [0, 2, 3, 5, 8, 10, 10, 12]
    assert a.times(x, 0.0, y, 1.0).df.count() == 7
    assert not mat(spark, [[1, 2], [3, 4]]).is_symmetric().first()[0]


def test_assembly(spark):
    i = [0, 11, 12, 13, 34, 51, 60, 17, 18, 29, 31, 54, 73]
    v = [1, -5, 1, -1, 2, 1, 3, 4, 5, 8, -3, -2, -4]
    rows = spark.createDataFrame([(k, a, float(b)) for k, (a, b) in enumerate(zip(i + i, v + v))], "seq long, i long, v double")
    assert {r.i: r.v for r in assemble_vector(rows, 100).df.collect()} == {a: 2.0 * b for a, b in zip(i, v)}
    assert {r.i: r.v for r in assemble_vector(rows, 100, "copy").df.collect()} == dict(zip(i, map(float, v)))
    triples = rows.select("seq", "i", (F.col("i") % 3).alias("j"), "v")
    assert assemble_matrix(triples, 100, 3, "max").df.count() == 13


@pytest.mark.parametrize("n", [1, 2, 8, 32, 128])
def test_fft(spark, n):
    z = np.random.default_rng(n).normal(size=(n, 2)) @ [1, 1j]
    x = spark.createDataFrame(pd.DataFrame({"i": range(n), "re": z.real, "im": z.imag}))
    got = fft.fft(x, n).orderBy("i").toPandas()
    assert np.allclose(got.re + 1j * got.im, np.fft.fft(z))
    with pytest.raises(ValueError):
        fft.fft(x, 3 * n)


def test_fft_of_rows_columns_and_both(spark):
    z = np.random.default_rng(5).normal(size=(8, 16, 2)) @ [1, 1j]
    z[3], z[:, 2] = 0, 0
    x = spark.createDataFrame([(i, j, float(z[i, j].real), float(z[i, j].imag)) for i in range(8) for j in range(16) if z[i, j]], "i long, j long, re double, im double")

    def whole(df):
        out = np.zeros((8, 16), complex)
        for r in df.collect():
            out[r.i, r.j] = r.re + 1j * r.im
        return out

    assert np.allclose(whole(fft.fft_rows(x, 16)), np.fft.fft(z, axis=1))
    assert np.allclose(whole(fft.fft_rows(x, 8, dim=0)), np.fft.fft(z, axis=0))
    assert np.allclose(whole(fft.fft_2d(fft.fft_2d(x, 8, 16), 8, 16, inverse=True)) / 128, z)


def test_product_with_hot_inner_indexes(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 3, (40, 7)).astype(float), rng.integers(0, 3, (7, 9)).astype(float)
    a[:, 2], a[:, 4] = 1, 0
    a[3, 4] = 5
    assert np.allclose(dense(mat(spark, a).matmul(mat(spark, b), 2.0, mat(spark, a @ b), -1.0, hot=8)), a @ b)
    assert mat(spark, np.zeros((2, 2))).matmul(mat(spark, np.eye(2)), hot=1).df.count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_kaczmarz_by_blocks(spark, blocks):
    """Against the same projections in numpy; three blocks of three rows are the row-by-row order."""
    b = A3 @ [1, 2, -1.0]
    x = np.zeros(3)
    for _ in range(3):
        for k in range(blocks):
            rows = np.arange(k, 3, blocks)
            x = x + 0.8 * sum(A3[i] * (b[i] - A3[i] @ x) / (A3[i] @ A3[i]) for i in rows)
    got = solve(mat(spark, A3), vec(spark, b), "kaczmarz", stop=iterations(3), omega=0.8, blocks=blocks)
    assert np.allclose(values(got.x), x)


def test_stencils(spark):
    grid, s = Grid((3, 4), (False, True)), Stencil.laplace(2, 5)
    x = vec(spark, range(12))
    assert np.allclose(values(apply_stencil(x, grid, s)), dense(stencil_matrix(spark, grid, s)) @ np.arange(12))


A3 = np.array([[9, 1, 2], [-2, 7, 1], [-1, 1, 8]], float)
S3 = np.array([[9, 1, 2], [1, 7, 1], [2, 1, 8]], float)


@pytest.mark.parametrize("method", sorted(SOLVERS))
def test_solvers(spark, method):
    a = S3 if method in ("cg", "minres", "amg", "kaczmarz") else A3
    x = np.array([1, 2, -1.0])
    a = np.tril(a) if method == "triangular" else a
    options = {} if method in ("inverse", "decomposition", "damped", "triangular") else {"stop": residual_below(1e-6) | iterations(30)}
    if method == "richardson":
        options["omega"] = 0.1
    if method == "kaczmarz":
        options["omega"] = 0.7
    got = solve(mat(spark, a), vec(spark, a @ x), method, **options)
    assert np.allclose(values(got.x), x, atol=1e-3)


def test_indefinite_system_and_inverse(spark):
    a = np.array([[1, 2, 3, 2], [2, 4, -1, -1], [3, -1, 2, 7], [2, -1, 7, -4]], float)
    got = solve(mat(spark, a), vec(spark, a @ [1, 3, -1, 2]), "minres", stop=iterations(5) | residual_below(1e-8))
    assert np.allclose(values(got.x), [1, 3, -1, 2], atol=1e-4)
    assert np.allclose(dense(inverse(mat(spark, a))) @ a, np.eye(4), atol=1e-8)


def test_constrained_least_squares(spark):
    a = mat(spark, np.diag([2.0, 3.0, 4.0]))
    got = app.constrained_least_squares(a, a.times(vec(spark, [1, 2, 3])), vec(spark, [0.5] * 3), vec(spark, [2.5] * 3), 1e-3)
    assert np.allclose(values(got.x), [1, 2, 2.5], atol=0.02)


def test_bounds_hold_back_a_system_with_more_rows_than_unknowns(spark):
    rng = np.random.default_rng(3)
    a = np.vstack([3 * np.eye(6) + 0.3 * rng.normal(size=(6, 6)), np.eye(6)])
    x, pull = np.array([1, 3, 1.4, 2.2, 3, 1.8]), np.array([1, -1, 0, 0, -0.7, 0])
    upper = rng.normal(size=6) / 10
    b = a @ x - np.concatenate([upper, pull - a[:6].T @ upper])
    assert np.allclose(2 * a.T @ (a @ x - b), 2 * pull)  # the conditions of the optimum
    got = app.constrained_least_squares(mat(spark, a), vec(spark, b), vec(spark, [1] * 6), vec(spark, [3] * 6), 1e-3, growth=20.0, inner=0.05)
    assert np.allclose(values(got.x), x, atol=5e-3) and got.residuals[-1] < got.residuals[0]


def test_partitioning(spark):
    assert general_block_offsets(10, [1, 2, 1]) == [3, 8, 10]
    assert proc_grid(12, (60, 20)) == (6, 2)
    e = [(a, b) for g in (0, 5) for a in range(g, g + 5) for b in range(g, g + 5) if a != b]
    shuffled = [(a * 2 % 10 + a // 5, b * 2 % 10 + b // 5) for a, b in e]
    m = Matrix(spark.createDataFrame([(a, b, 1.0) for a, b in shuffled], "i long, j long, v double"), 10, 10)
    owners = weighted_blocks(m, [1, 1], rounds=4)
    assert owners.count() == 10 and edge_cut(m, owners).first()[1] == 20


def test_random_is_the_same_in_any_partitioning(spark):
    a = generate.random_vector(spark, 100, 2.0, 4).df
    assert a.orderBy("i").toPandas().equals(generate.random_vector(spark, 100, 2.0, 4).df.repartition(3).orderBy("i").toPandas())


@pytest.mark.parametrize("suffix", ["mtx", "txt", "tsr"])
def test_text_and_native_files(spark, tmp_path, suffix):
    for a in (TD1, S3):
        path = f"{tmp_path}/{a.shape[0]}.{suffix}"
        files.write(mat(spark, a), path)
        assert np.allclose(dense(files.read(spark, path)), a)
    files.write(vec(spark, [3, 1, 2.5]), f"{tmp_path}/v.{suffix}")


def test_mtx_forms(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix array real general\n% by columns\n2 3\n1\n2\n3\n4\n5\n6\n")
    (tmp_path / "h.mtx").write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 5 0\n2 1 1 2\n")
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n1 1\n3 1\n")
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix array real symmetric\n3 3\n1\n2\n3\n4\n5\n6\n")
    assert dense(text.read_mtx(spark, f"{tmp_path}/a.mtx")).tolist() == [[1, 3, 5], [2, 4, 6]]
    rows, _ = text.read_mtx_complex(spark, f"{tmp_path}/h.mtx")
    assert {(r.i, r.j): (r.re, r.im) for r in rows.collect()} == {(0, 0): (5, 0), (1, 0): (1, 2), (0, 1): (1, -2)}
    assert dense(text.read_mtx(spark, f"{tmp_path}/p.mtx")).tolist() == [[1, 0, 1], [0, 0, 0], [1, 0, 0]]
    assert dense(text.read_mtx(spark, f"{tmp_path}/s.mtx")).tolist() == [[1, 2, 3], [2, 4, 5], [3, 5, 6]]


def test_samg_and_petsc(spark, tmp_path):
    (tmp_path / "f.frm").write_text("f 4\n4 3 22 1 0\n")
    (tmp_path / "f.amg").write_text("1\n3\n3\n5\n1\n3\n2\n3\n5\n6\n7\n8\n")
    want = [[5, 0, 6], [0, 0, 0], [0, 7, 8]]
    assert dense(files.read(spark, f"{tmp_path}/f.frm")).tolist() == want
    (tmp_path / "x.frm").write_text("x 4\n4 3 22 1 0\n")
    (tmp_path / "x.amg").write_bytes(np.array([1, 3, 3, 5, 1, 3, 2, 3], ">i4").tobytes() + np.array([5, 6, 7, 8], ">f8").tobytes())
    assert dense(files.read(spark, f"{tmp_path}/x.frm")).tolist() == want
    raw = np.array([1211216, 3, 3, 4, 2, 0, 2, 0, 2, 1, 2], ">i4").tobytes() + np.array([5, 6, 7, 8], ">f8").tobytes()
    (tmp_path / "a.psc").write_bytes(raw)
    assert dense(files.read(spark, f"{tmp_path}/a.psc")).tolist() == want
    for suffix in ("psc", "frm", "mat"):
        files.write(mat(spark, want), f"{tmp_path}/b.{suffix}")
        assert dense(files.read(spark, f"{tmp_path}/b.{suffix}")).tolist() == want
    assert (tmp_path / "b.psc").read_bytes() == raw
    binary.write_samg(mat(spark, want), f"{tmp_path}/t.frm", "f")
    assert (tmp_path / "t.frm").read_text() == "f 4\n4 3 22 1 0\n" and dense(files.read(spark, f"{tmp_path}/t.frm")).tolist() == want
    written = "".join(p.read_text() for p in sorted((tmp_path / "t.amg").glob("part-*"))).split()
    assert [float(x) for x in written] == [1, 3, 3, 5, 1, 3, 2, 3, 5, 6, 7, 8]
    binary.write_samg_vector(vec(spark, [1.5, 0, -3]), f"{tmp_path}/t.frv", "f")
    assert values(files.read(spark, f"{tmp_path}/t.frv")).tolist() == [1.5, 0, -3]
    with pytest.raises(ValueError):
        binary.write_samg(mat(spark, want), f"{tmp_path}/t.frm", "x")
    files.write(vec(spark, [1, 2, 3]), f"{tmp_path}/v.psc")
    files.write(vec(spark, [1, 2, 3]), f"{tmp_path}/w.frv")
    assert values(files.read(spark, f"{tmp_path}/w.frv")).tolist() == [1, 2, 3]
    assert values(files.read(spark, f"{tmp_path}/v.psc")).tolist() == [1, 2, 3]
    (tmp_path / "v.frv").write_text("f\n3\n8\n")
    (tmp_path / "v.vec").write_text("1.5\n2\n3\n")
    assert values(files.read(spark, f"{tmp_path}/v.frv")).tolist() == [1.5, 2, 3]


def test_images_and_mat(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (binary.decode_png(binary.png_bytes(pixels)) == pixels).all()
    assert (binary.decode_bmp(binary.bmp_bytes(pixels)) == pixels).all()
    (tmp_path / "a.png").write_bytes(binary.png_bytes(pixels))
    x, grid = binary.read_image(spark, f"{tmp_path}/a.png")
    assert grid.shape == (5, 7, 3) and (values(x).reshape(5, 7, 3) == pixels).all()
    for suffix in ("png", "bmp"):
        files.write((x, grid), f"{tmp_path}/b.{suffix}")
        assert (values(files.read(spark, f"{tmp_path}/b.{suffix}")).reshape(5, 7, 3) == pixels).all()
    a = np.array([[1.5, 0, 0, 0], [0, 0, 0, 3], [-2, 0, 0, 0]])
    files.write(mat(spark, a), f"{tmp_path}/a.mat")
    got = files.read(spark, f"{tmp_path}/a.mat")
    assert (dense(got) == a).all() and (got.n, got.m) == (3, 4)


def test_complex_vectors_and_matrices(spark, tmp_path):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(4, 3)) + 1j * rng.normal(size=(4, 3))
    m = ComplexMatrix(spark.createDataFrame([(i, j, float(z[i, j].real), float(z[i, j].imag)) for i in range(4) for j in range(3)], "i long, j long, re double, im double"), 4, 3)
    vector = lambda v: ComplexVector(spark.createDataFrame([(k, float(x.real), float(x.imag)) for k, x in enumerate(v)], "i long, re double, im double"), len(v))

    def array(x):
        out = np.zeros(x.n, complex)
        for r in x.df.collect():
            out[r.i] = complex(r.re, r.im)
        return out

    x, y = z[0], z[:, 1]
    forms = {"normal": z, "conj": z.conj(), "transpose": z.T, "conj_transpose": z.conj().T}
    for name, want in forms.items():
        at, base = (x, y) if want.shape == (4, 3) else (y, x)
        assert np.allclose(array(m.times(vector(at), 2 - 1j, vector(base), 1j, name)), (2 - 1j) * want @ at + 1j * base)
    assert np.allclose(complex(*vector(y).dot(vector(y * 2j)).first()), np.vdot(y, y * 2j))
    assert np.isclose(vector(y).l2_norm().first()[0], np.linalg.norm(y)) and np.isclose(vector(y).max_norm().first()[0], abs(y).max())
    assert np.isclose(vector(y).l1_norm().first()[0], (abs(y.real) + abs(y.imag)).sum())
    assert np.allclose(array(vector(y).plus(vector(y).conj(), 1j, 3)), 1j * y + 3 * y.conj())
    assert m.matmul(m, "conj_transpose").is_hermitian().first()[0] in (True, False) and not m.form("normal").l2_norm().first()[0] == 0
    for suffix in ("mat", "mtx"):
        files.write(m, f"{tmp_path}/c.{suffix}")
        got = files.read(spark, f"{tmp_path}/c.{suffix}")
        assert {(r.i, r.j): complex(r.re, r.im) for r in got.df.collect()} == {(i, j): z[i, j] for i in range(4) for j in range(3)}


def test_implicit_values_are_ieee():
    from tessera.functions.scalar import python_value

    inf, nan = float("inf"), float("nan")
    same = lambda a, b: a == b or (a != a and b != b)
    wanted = {("exp", 1000): inf, ("exp", -inf): 0, ("pow", 0, -1): inf, ("pow", -2, 0.5): nan, ("floor", inf): inf, ("ceil", nan): nan, ("log", 0): -inf, ("log", -1): nan, ("sqrt", -1): nan, ("sin", inf): nan, ("divide", 0, 0): nan, ("divide", -3, 0): -inf, ("modulo", 5, 0): nan, ("max", nan, 1): nan, ("min", nan, 1): 1, ("sqr", 1e200): inf, ("reciprocal", 0): inf, ("sign", nan): 0, ("sign", -inf): -1}
    for (op, *x), want in wanted.items():
        assert same(python_value(op, *map(float, x)), want), (op, x)


def test_implicit_values_are_those_of_columns(spark):
    from tessera.functions.scalar import BINARY, UNARY, python_value

    points = [0.0, -1.0, 1000.0, 2.5, float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(a, b) for a in points for b in points], "a double, b double")
    got = rows.select("a", "b", *[f(F.col("a")).alias(n) for n, f in UNARY.items()], *[f(F.col("a"), F.col("b")).alias(f"two {n}") for n, f in BINARY.items()]).collect()
    for r in got:
        for n in UNARY:
            assert np.isclose(r[n], python_value(n, r.a), equal_nan=True), (n, r.a, r[n])
        for n in BINARY:
            assert np.isclose(r[f"two {n}"], python_value(n, r.a, r.b), equal_nan=True), (n, r.a, r.b, r[f"two {n}"])


def test_operators_and_preconditioners(spark):
    x = np.array([1, 2, -1.0])
    a, b = mat(spark, S3), vec(spark, S3 @ x)
    by = Operator(3, lambda v: a.times(v), lambda v: a.times(v, transposed=True), a.diagonal().to_dense())
    for method in ("cg", "bicgstab", "cgs", "gmres"):
        for pre in (trivial, diagonal, by_solver("jacobi", 2)):
            assert np.allclose(values(solve(by if pre is diagonal else a, b, method, stop=residual_below(1e-8) | iterations(20), preconditioner=pre).x), x, atol=1e-5)
    for method in ("minres", "qmr", "jacobi"):
        assert np.allclose(values(solve(by, b, method, stop=residual_below(1e-7) | iterations(30)).x), x, atol=1e-4)
    for symmetric in (False, True):
        assert np.allclose(values(decomposition_solve(a, b, symmetric, size=2).x), x)


def test_kaczmarz_by_colours_is_the_sequential_sweep(spark):
    rng = np.random.default_rng(2)
    n = 14
    a = np.diag(rng.uniform(2, 3, n)) + np.diag(rng.uniform(-1, 1, n - 1), 1) + np.diag(rng.uniform(-1, 1, n - 3), -3)
    colours, k = row_colours(mat(spark, a))
    colour = {r.i: r.colour for r in colours.collect()}
    assert sorted(colour) == list(range(n)) and set(colour.values()) == set(range(k))
    for i in range(n):
        for j in range(i):
            assert colour[i] != colour[j] or not (a[i] * a[j]).any()
    b, x = a @ rng.normal(size=n), np.zeros(n)
    for _ in range(2):
        for i in sorted(range(n), key=lambda i: colour[i]):
            x += (b[i] - a[i] @ x) / (a[i] @ a[i]) * a[i]
    got = solve(mat(spark, a), vec(spark, b), "kaczmarz", stop=iterations(2), blocks=None)
    assert np.allclose(values(got.x), x)


def test_triangular_systems(spark):
    t = np.array([[2, 0, 0, 0], [1, 3, 0, 0], [0, -1, 4, 0], [5, 0, 1, 1]], float)
    x = np.array([1, -2, 3, 0.5])
    assert np.allclose(values(triangular_solve(mat(spark, t), vec(spark, t @ x)).x), x)
    assert np.allclose(values(triangular_solve(mat(spark, t.T), vec(spark, t.T @ x), lower=False).x), x)


def test_triangular_systems_of_chains_trees_and_full_rows(spark):
    rng = np.random.default_rng(5)
    n = 40
    chain = np.diag(rng.uniform(1, 2, n)) + np.diag(rng.uniform(-1, 1, n - 1), -1)
    tree = np.diag(rng.uniform(1, 2, n))
    for k in range(1, n):
        tree[k, rng.integers(k)] = rng.uniform(-1, 1)
    ladder = chain.copy()
    ladder[np.arange(9, n, 9), np.arange(9, n, 9) - 5] = 0.5
    full = np.tril(rng.normal(size=(n, n))) / 4 + np.diag(np.full(n, 3.0))
    x = rng.normal(size=n)
    for t, most in ((chain, 1), (tree, 1), (ladder, 6), (full, 1)):
        found, rounds = triangular(mat(spark, t), vec(spark, t @ x), size=16)
        assert np.allclose(values(found), x) and rounds <= most
        assert np.allclose(values(triangular(mat(spark, t.T), vec(spark, t.T @ x), lower=False, size=16)[0]), x)
    with pytest.raises(ValueError, match="gaps"):
        triangular(mat(spark, np.array([[1.0, 0], [1, 0]])), vec(spark, [1.0, 2]))


def test_writes_to_sparse_vectors_keep_every_value(spark):
    rows = spark.createDataFrame([(0, 5.0), (5, 2.0)], "i long, v double")
    x = Vector(rows, 8, 0.0, False)
    assert {r.i: r.v for r in x.put_section(0, 3, vec(spark, [9.0, 9, 9])).df.collect()} == {0: 9, 3: 9, 5: 2, 6: 9}
    assert {r.i: r.v for r in x.put_section(4, 1, Vector(rows.filter("i = 0"), 2, 1.0, False), "add").df.collect()} == {0: 5, 4: 5, 5: 3}
    index, source = vec(spark, [7, 0, 7]), vec(spark, [1.0, 2, 3])
    assert {r.i: r.v for r in x.scatter(index, source).df.collect()} == {0: 2, 5: 2, 7: 3}
    assert {r.i: r.v for r in x.scatter(index, source, "add").df.collect()} == {0: 7, 5: 2, 7: 4}
    one = Vector(rows, 8, 1.0, False).scatter(index, source, "sub")
    assert {r.i: r.v for r in one.df.collect()} == {0: 3, 5: 2, 7: -3}


def test_quotients_of_implicit_zeros(spark):
    rows = spark.createDataFrame([(0, 5.0)], "i long, v double")
    x, d = Vector(rows, 3, 0.0, False), vec(spark, [2.0, 0, 4])
    got = values(x.binary("divide", d))
    assert got[0] == 2.5 and np.isnan(got[1]) and got[2] == 0
    both = x.binary("divide", Vector(rows, 3, 0.0, False))
    assert np.isnan(both.zero) and [tuple(r) for r in both.df.collect()] == [(0, 1.0)]


@pytest.mark.parametrize("density", [0.0, 0.01, 0.05, 0.5, 1.0])
def test_random_matrices_have_their_density(spark, density):
    n, m = 400, 300
    a = generate.random_matrix(spark, n, m, density, 7)
    assert a.consistent().first().ok
    found = a.df.selectExpr("count(*) AS c", "coalesce(avg(v), 0.5) AS v", "coalesce(avg(j), 149.5) AS j").first()
    spread = (density * (1 - density) * n * m) ** 0.5
    assert abs(found.c - density * n * m) <= 4 * spread
    if density:
        assert abs(found.v - 0.5) < 0.05 and abs(found.j - 149.5) < 12


def test_n_body_agrees_with_all_pairs(spark):
    rng = np.random.default_rng(1)
    p = rng.random((40, 2))
    rows = [(k, 1.0, float(a), float(b), 0.0, 0.0) for k, (a, b) in enumerate(p)]
    moved = app.n_body_step(spark.createDataFrame(rows, "i long, m double, x double, y double, vx double, vy double"), 1.0, 0.01, 3).orderBy("i").toPandas()
    d = p[None] - p[:, None]
    r = (d**2).sum(axis=2) + 0.01
    force = (d / r[..., None] ** 1.5).sum(axis=1)
    assert np.abs(moved[["vx", "vy"]].to_numpy() - force).max() < 0.1 * np.abs(force).max()


def test_stream_assembly(spark, tmp_path):
    from tessera.streaming.assembly import folded_stream, run_once, windowed_stream

    rows = spark.createDataFrame([(k % 3, float(k)) for k in range(30)], "i long, v double")
    for part in range(2):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i long, v double").parquet(f"{tmp_path}/in")
    got = {r.i: r.v for r in run_once(folded_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    assert got == {i: 2.0 * sum(k for k in range(30) if k % 3 == i) for i in range(3)}
    timed = windowed_stream(stream.withColumn("t", F.timestamp_seconds("v")), "t", "10 seconds", "1 minute", op="max")
    assert timed.isStreaming and timed.columns == ["start", "i", "v"]
    found = {(r.start.second, r.i): r.v for r in run_once(timed, f"{tmp_path}/timed", f"{tmp_path}/timed-state").collect()}
    assert found == {(w, i): float(max(k for k in range(w, w + 10) if k % 3 == i)) for w in (0, 10, 20) for i in range(3)}


def test_scratch_tables_go_at_the_end(spark):
    import os

    from tessera.plans.storage import scratch, stored

    with scratch(spark) as path:
        kept = stored(spark.range(5).toDF("i"), "t").count()
        assert os.listdir(path.removeprefix("file://"))
    assert kept == 5 and not os.path.exists(path.removeprefix("file://"))
    assert stored(spark.range(3).toDF("i"), "t").count() == 3


def test_entry_without_the_training_data_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    assert set(entry.queries()) == set(entry.oracle_sql()) and len(entry.queries()) > 300
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
