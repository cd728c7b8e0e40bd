"""What the third review found."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.scalar import rounded


def test_rounding_next_to_a_half_is_that_of_sql(spark):
    """values that are a half in decimals and next to one in doubles."""
    made = np.arange(1, 6000) * 1e-4 + 0.5e-4
    made = np.concatenate([made, -made, np.nextafter(made, 0), np.nextafter(made, 1)])
    other = [float("nan"), float("inf"), -float("inf"), 0.0, 0.49999999999999994e-4, 1e300, -1e307, 4503599627370497.5]
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate([*made, *other])], "k long, v double")
    got = rows.select("k", rounded("v", 4).alias("r"), F.round("v", 4).alias("s")).toPandas().sort_values("k")
    frame = rows.toPandas()  # noqa: F841
    expected = duckdb.sql("SELECT round(v, 4) AS r FROM frame ORDER BY k").df()["r"].to_numpy()
    assert np.array_equal(got["r"].to_numpy(), expected, equal_nan=True)
    assert not np.array_equal(got["s"].to_numpy(), expected, equal_nan=True), "the decimal rounding differs here"


def test_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    """a written table of many rows can have few bytes."""
    from tessera.operators.triangular import folded
    from tessera.plans import partition, storage
    from tessera.plans.vector import Vector

    n = 400_000
    owners = storage.stored(spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 5).cast("int").alias("owner")), "plan")
    x = Vector(storage.stored(spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), "x"), n)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(partition.by_lookup(x, owners))
    assert partition.by_lookup(x, owners).count() == n
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 100)
    chain = spark.range(1, 200).select(F.col("id").alias("i"), (F.col("id") - 1).alias("p"), F.lit(1.0).alias("a"), F.lit(1.0).alias("w"))
    assert {(r.p, r.a - r.i) for r in folded(storage.cut(chain), 199).collect()} == {(0, 0.0)}


def test_tiles_are_handed_on_in_bounded_batches():
    """A batch of ten thousand narrow rows is no batch of ten thousand tiles."""
    from tessera.plans.tiles import HANDED, handed_on

    sizes = []
    for b in handed_on((k, 0, np.zeros((256, 256))) for k in range(400)):
        sizes.append((b.num_rows, b.nbytes))
    assert sum(n for n, _ in sizes) == 400 and max(size for _, size in sizes) < 1.1 * HANDED


def test_bodies_of_one_place_act_as_one(spark, monkeypatch):
    """pairs of bodies are pairs of places, dealt over several tasks; forces are those of all pairs."""
    from tessera.operators import applications as app

    monkeypatch.setattr(app, "PAIRED", 4)
    rows = [(k, 1.0 + k % 3, float(k * 37 % 11), float(k * 53 % 3), 0.5, 0.0) for k in range(150)]
    got = app.n_body_step(spark.createDataFrame(rows, "i long, m double, x double, y double, vx double, vy double"), 0.5, levels=1).orderBy("i").collect()
    b = np.array(rows)
    dx, dy = b[None, :, 2] - b[:, None, 2], b[None, :, 3] - b[:, None, 3]
    r = (dx * dx + dy * dy + 1e-3) ** 1.5
    assert [g.i for g in got] == list(range(150))
    assert np.allclose([g.vx for g in got], 0.5 + 0.5 * (b[None, :, 1] * dx / r).sum(axis=1))
    assert np.allclose([g.vy for g in got], 0.5 * (b[None, :, 1] * dy / r).sum(axis=1))
    assert len({(x[2], x[3]) for x in rows}) < 40


def test_dominant_triangular_systems_stay_sparse(spark, monkeypatch):
    """rows that need many others are solved without tiles where the diagonal outweighs them."""
    from tessera.operators import triangular as tri
    from tessera.plans.matrix import Matrix
    from tessera.plans.vector import Vector

    rng = np.random.default_rng(5)
    n = 60
    a = np.tril(np.where(rng.random((n, n)) < 0.4, rng.normal(size=(n, n)), 0.0), -1)
    a += np.diag(np.abs(a).sum(axis=1) * 1.5 + 1)
    x = rng.normal(size=n)
    frame = lambda values, types: spark.createDataFrame(values, types)
    m = Matrix(frame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v double"), n, n)
    b = Vector(frame([(k, float(v)) for k, v in enumerate(a @ x)], "i long, v double"), n)
    monkeypatch.setattr(tri, "_by_blocks", lambda *_: pytest.fail("tiles were made"))
    got = tri.triangular(m, b, worth=0.0)[0].df.orderBy("i").collect()
    assert np.allclose([r.v for r in got], x, rtol=1e-12)
