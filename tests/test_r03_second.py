"""What the third review found, continued."""

from __future__ import annotations

import numpy as np
import pytest


@pytest.mark.parametrize("sent, chained", [(1 << 18, 8), (0, 8), (0, 1)])
def test_a_kaczmarz_sweep_is_one_plan(spark, monkeypatch, sent, chained):
    """no table is written between the blocks of a sweep, and all forms of a sweep give the same."""
    from tessera.operators import solvers
    from tessera.plans import storage
    from tessera.plans.matrix import Matrix
    from tessera.plans.vector import Vector

    monkeypatch.setattr(storage, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(solvers, "CHAINED", chained, raising=False)
    written, cut = [], solvers.cut
    monkeypatch.setattr(solvers, "cut", lambda df: written.append(1) or cut(df))
    a = np.array([[9, 1, 2, 0], [-2, 7, 1, 0], [-1, 1, 8, 0], [0, 0, 0, 0]], float)
    b, x = a @ [1, 2, -1, 0], np.zeros(4)
    for _ in range(3):
        for k in range(2):
            x = x + 0.8 * sum(a[i] * (b[i] - a[i] @ x) / (a[i] @ a[i]) for i in range(k, 4, 2) if a[i].any())
    m = Matrix(spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v double"), 4, 4)
    right = Vector(spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "i long, v double"), 4)
    got = solvers.solve(m, right, "kaczmarz", stop=solvers.iterations(3), omega=0.8, blocks=2)
    assert np.allclose([r.v for r in got.x.df.orderBy("i").collect()], x)
    assert np.isclose(got.residuals[-1], np.linalg.norm(b - a @ x))
    assert len(written) <= (5 + 3 if chained > 1 else 5 + 6)


@pytest.mark.parametrize("kind", ["psc", "frm", "mat", "complex"])
def test_matrix_files_are_read_by_ranges(spark, tmp_path, monkeypatch, kind):
    """One file is many tasks, each of which has a piece of its entries in memory; whole files are read where it can't be opened."""
    from pyspark.sql import functions as F

    from tessera.plans.complex import ComplexMatrix
    from tessera.plans.matrix import Matrix
    from tessera.sources import binary, files

    monkeypatch.setattr(binary, "RANGE_ROWS", 7, raising=False)
    monkeypatch.setattr(binary, "RANGE_ENTRIES", 3, raising=False)
    n = 40
    rows = spark.range(n * n).select((F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"), (F.col("id") * 0.25 - 9).alias("v"))
    rows = rows.filter("i * j % 7 = 3 or i = 11").filter("i < 36 and i != 20")
    x = ComplexMatrix(rows.select("i", "j", F.col("v").alias("re"), (F.col("v") / 3).alias("im")), n, n) if kind == "complex" else Matrix(rows, n, n)
    path = str(tmp_path / ("x.mat" if kind == "complex" else f"x.{kind}"))
    files.write(x, path)
    got = files.read(spark, path)
    assert type(got) is type(x) and (got.n, got.m) == (n, n)
    assert got.df.rdd.getNumPartitions() == 6
    expected = sorted(map(tuple, x.df.collect()))
    assert sorted(map(tuple, got.df.select(*x.df.columns).collect())) == expected
    monkeypatch.setattr(binary, "_openable", lambda path: False)
    assert sorted(map(tuple, files.read(spark, path).df.select(*x.df.columns).collect())) == expected


@pytest.mark.parametrize("form", ["b", "f"])
def test_a_samg_write_makes_its_matrix_once(spark, tmp_path, form):
    """the sections of the file read what was made, they don't make it again."""
    from tessera.plans.matrix import Matrix
    from tessera.sources import binary, files

    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    n = 30
    rows = spark.range(n).selectExpr("id AS i", "(id * 7) % 30 AS j", "id + 0.5D AS v")
    path = str(tmp_path / "x.frm")
    binary.write_samg(Matrix(rows.mapInPandas(counted, "i long, j long, v double"), n, n), path, form)
    assert made.value == n
    assert sorted(map(tuple, files.read(spark, path).df.select("i", "j", "v").collect())) == sorted(map(tuple, rows.collect()))
