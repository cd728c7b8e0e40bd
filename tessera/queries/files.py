"""Round trips through the file formats, over what the shared tables give."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.plans.grid import Grid
from tessera.plans.matrix import Matrix
from tessera.plans.storage import shared_dir, stored
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables, matrix_out, vector_out
from tessera.sources import binary, files, tables, text
from tessera.streaming.assembly import folded_stream, last_stream, run_append, run_once, windowed_stream

R = Registry()
T = Tables


def _place(s, suffix: str) -> str:
    return f"{shared_dir(s)}/tessera/file-{uuid.uuid4().hex}.{suffix}"


def _through(s, x, suffix: str):
    path = _place(s, suffix)
    files.write(x, path)
    return files.read(s, path)


R.add("io01_read_mtx", lambda s, d: matrix_out(_through(s, T(s, d).spd, "mtx")), "SELECT i, j, round(v, 4) AS v FROM spd")
R.add("io03_write_mtx_general", lambda s, d: matrix_out(_through(s, T(s, d).s, "mtx")), "SELECT i, j, round(v, 4) AS v FROM s")


@R.query("io02_mtx_vectors", "SELECT i, round(v, 4) AS v FROM p UNION ALL SELECT i + 1000000, round(v, 4) FROM y")
def _(s, d):
    dense, sparse = _place(s, "mtx"), _place(s, "mtx")
    text.write_mtx_vector(T(s, d).p, dense)
    text.write_mtx_vector(T(s, d).y, sparse)
    moved = text.read_mtx_vector(s, sparse).df.select((F.col("i") + 1_000_000).alias("i"), "v")
    return vector_out(Vector(text.read_mtx_vector(s, dense).df.unionByName(moved), 0))


R.add("io04_mat", lambda s, d: matrix_out(_through(s, T(s, d).s, "mat")), "SELECT i, j, round(v, 4) AS v FROM s")
R.add("io05_samg", lambda s, d: matrix_out(_through(s, T(s, d).near, "frm"), 6), "SELECT i, j, round(v, 6) AS v FROM near")
R.add("io05_samg_vector", lambda s, d: vector_out(_through(s, T(s, d).p, "frv")), "SELECT i, round(v, 4) AS v FROM p")


def _formatted(s, x, suffix: str, write):
    path = _place(s, suffix)
    write(x, path, "f")
    return files.read(s, path)


R.add("io05_samg_text", lambda s, d: matrix_out(_formatted(s, T(s, d).near, "frm", binary.write_samg), 6), "SELECT i, j, round(v, 6) AS v FROM near")
R.add("io05_samg_vector_text", lambda s, d: vector_out(_formatted(s, T(s, d).p, "frv", binary.write_samg_vector)), "SELECT i, round(v, 4) AS v FROM p")
R.add("io06_petsc", lambda s, d: matrix_out(_through(s, T(s, d).s, "psc")), "SELECT i, j, round(v, 4) AS v FROM s")
R.add("io06_petsc_vector", lambda s, d: vector_out(_through(s, T(s, d).p, "psc")), "SELECT i, round(v, 4) AS v FROM p")


@R.query("io07_txt", "SELECT i, j, round(v, 4) AS v FROM s")
def _(s, d):
    return matrix_out(_through(s, T(s, d).s, "txt"))


R.add("io07_txt_vector", lambda s, d: _txt_vector(s, d), "SELECT i, round(v, 4) AS v FROM p")


def _txt_vector(s, d):
    path = _place(s, "txt")
    text.write_txt(T(s, d).p, path)
    return vector_out(text.read_txt_vector(s, path))


R.add("io08_native", lambda s, d: matrix_out(_through(s, T(s, d).a, "tsr")), "SELECT i, j, round(v, 4) AS v FROM a")
R.add("io08_native_sparse_vector", lambda s, d: vector_out(_through(s, T(s, d).y.scalar("add", 1.0), "tsr").to_dense()), "SELECT i, round(v + 1, 4) AS v FROM yd")


def _image(s, d, kind: str):
    c = T(s, d).c
    grey = Vector(c.df.select((F.col("i") * 25 + F.col("j")).alias("i"), F.floor(F.col("v") * 10 % 256).cast("double").alias("v")), 625)
    rgb = grey.df.select((F.col("i") * 3).alias("i"), F.posexplode(F.array("v", F.lit(255) - F.col("v"), F.lit(7.0))).alias("k", "w")).select((F.col("i") + F.col("k")).alias("i"), F.col("w").alias("v"))
    return vector_out(_through(s, (Vector(rgb, 1875), Grid((25, 25, 3))), kind))


_IMAGE = "SELECT (x * 25 + y) * 3 + k AS i, CASE WHEN g IS NULL THEN 0 WHEN k = 0 THEN g WHEN k = 1 THEN 255 - g ELSE 7 END::DOUBLE AS v FROM range(25) a(x), range(25) b(y), range(3) r(k) LEFT JOIN (SELECT i, j, floor((v * 10) % 256) AS g FROM c) q ON q.i = x AND q.j = y"
R.add("io09_bmp", lambda s, d: _image(s, d, "bmp"), _IMAGE)
R.add("io10_png", lambda s, d: _image(s, d, "png"), _IMAGE)
R.add("io12_partitioned", lambda s, d: _partitioned(s, d), "SELECT CAST(i % 4 AS INTEGER) AS part, count(*) AS n, round(sum(v), 2) AS v FROM x GROUP BY 1")


def _partitioned(s, d):
    path = f"{shared_dir(s)}/tessera/parts-{uuid.uuid4().hex}"
    T(s, d).x.df.withColumn("part", (F.col("i") % 4).cast("int")).write.partitionBy("part").parquet(path)
    return s.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), rounded(F.sum("v"), 2).alias("v"))


@R.query("io13_distribution_file", "SELECT i, CAST((i // 5) % 3 AS INTEGER) AS owner FROM x")
def _(s, d):
    from tessera.plans.partition import cyclic_owner

    owners = T(s, d).x.df.select("i", cyclic_owner(F.col("i"), 5, 3).alias("owner"))
    return stored(owners, "owners").select("i", "owner")


@R.query("io14_size_probes", "SELECT n, m, k FROM (SELECT (SELECT max(p_partkey) + 1 FROM part) AS n, (SELECT max(s_suppkey) + 1 FROM supplier) AS m, count(*) AS k FROM s)")
def _(s, d):
    path = _place(s, "mtx")
    text.write_mtx(T(s, d).s, path)
    n, m, k = text.header(s, path).sizes
    return T(s, d).table("region").filter("r_regionkey = 0").select(F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k"))


@R.query("io15_exists_and_remove", "SELECT true AS before, false AS after FROM region WHERE r_regionkey = 0")
def _(s, d):
    path = _place(s, "tsr")
    files.write(T(s, d).known, path)
    before = files.exists(s, path)
    files.remove(s, path)
    return T(s, d).table("region").filter("r_regionkey = 0").select(F.lit(before).alias("before"), F.lit(files.exists(s, path)).alias("after"))


@R.query("io16_typed_write", "SELECT i, floor(v)::DOUBLE AS v FROM p")
def _(s, d):
    path = _place(s, "tsr")
    files.write(T(s, d).p, path, "long")
    return vector_out(files.read(s, path))


@R.query("io16_pattern", "SELECT i, j, 1.0::DOUBLE AS v FROM c")
def _(s, d):
    path = _place(s, "mtx")
    text.write_mtx(T(s, d).c, path, "pattern")
    return matrix_out(files.read(s, path))


@R.query("io18_from_driver_arrays", "SELECT k AS i, k * k * 0.5::DOUBLE AS v FROM range(32) r(k)")
def _(s, d):
    return vector_out(Vector.of(s.createDataFrame(pd.DataFrame({"i": range(32), "v": [k * k * 0.5 for k in range(32)]})), "i", "v", 32))


@R.query("io19_convert", "SELECT i, j, round(v, 4) AS v FROM c")
def _(s, d):
    one, two = _place(s, "tsr"), _place(s, "mtx")
    files.write(T(s, d).c, one)
    files.convert(s, one, two)
    return matrix_out(files.read(s, two))


@R.query("f04_own_format", "SELECT i, j, round(v, 4) AS v FROM c")
def _(s, d):
    """A format of one's own: rows as JSON."""
    files.register("jsn", lambda spark, path: Matrix(spark.read.schema("i long, j long, v double").json(path), 25, 25), lambda x, path: x.df.write.json(path))
    return matrix_out(_through(s, T(s, d).c, "jsn"))


@R.query("f04_data_source", "SELECT i, j, round(v, 4) AS v FROM a WHERE i % 2 = 1 OR i >= 100")
def _(s, d):
    """The matrix of orders written and read as a Spark data source of the library's own, in two ranges of rows."""
    tables.register(s)
    path = _place(s, "triples")
    T(s, d).a.df.repartitionByRange("i").write.format(tables.NAME).mode("overwrite").save(path)
    read = lambda **bounds: s.read.format(tables.NAME).options(partitionBytes=1 << 20, **bounds).load(path)
    return matrix_out(Matrix(read(**{"from": 100}).unionByName(read(to=99).filter("i % 2 = 1")), 0, 0))


@R.query("st01_stream_assembly", "SELECT user_id AS i, round(sum(value), 4) AS v FROM events GROUP BY 1")
def _(s, d):
    """The events table read as a stream and folded per user."""
    source = T(s, d).table("events")
    stream = s.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    place = f"{shared_dir(s)}/tessera/fold-{uuid.uuid4().hex}"
    folded = run_once(folded_stream(stream.select(F.col("user_id").alias("i"), F.col("value").alias("v"))), f"{place}/rows", f"{place}/state")
    return folded.select("i", rounded("v", 4).alias("v"))


@R.query("st02_windowed_assembly", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, user_id AS i, round(max(value), 4) AS v FROM events GROUP BY 1, 2")
def _(s, d):
    """The greatest value of each user and hour, of the events table read as a stream."""
    source = T(s, d).table("events")
    stream = s.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    place = f"{shared_dir(s)}/tessera/fold-{uuid.uuid4().hex}"
    timed = windowed_stream(stream.select(F.col("ts"), F.col("user_id").alias("i"), F.col("value").alias("v")), "ts", "1 hour", "30 days", op="max")
    return run_once(timed, f"{place}/rows", f"{place}/state").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "i", rounded("v", 4).alias("v"))


#: Of the events those of each tenth user in the first quarter of the time come last of all, long after their windows are final.
_LATE = "user_id % 10 = 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 4 FROM events)"


@R.query("st03_append_windows", f"WITH e AS (SELECT *, {_LATE} AS late, date_trunc('hour', ts) AS hour FROM events), m AS (SELECT max(ts) AS top FROM e WHERE NOT late) SELECT strftime(hour, '%Y-%m-%d %H') AS hour, user_id AS i, round(sum(value), 4) AS v FROM e, m WHERE NOT late AND hour + INTERVAL 1 HOUR <= top - INTERVAL 2 HOUR GROUP BY 1, 2")
def _(s, d):
    """Events in files by time, one a batch, and late ones in the last: windows are written once, when the watermark has passed them."""
    events = T(s, d).table("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("i"), F.col("value").alias("v"))
    low, high = events.agg(F.min(F.col("ts").cast("double")), F.max(F.col("ts").cast("double"))).first()
    seconds, source = F.col("ts").cast("double"), _place(s, "events")
    late = (F.col("i") % 10 == 0) & (seconds < low + (high - low) / 4)
    for k in range(4):
        part = (~late) & (F.least(F.floor((seconds - low) / (high - low) * 4), F.lit(3)) == k)
        events.filter(part).write.mode("append").parquet(source)
    events.filter(late).write.mode("append").parquet(source)
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    place = _place(s, "windows")
    found, _ = run_append(windowed_stream(stream, "ts", "1 hour", "2 hours"), f"{place}/rows", f"{place}/state")
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "i", rounded("v", 4).alias("v"))


@R.query("st04_copy_assembly", "SELECT user_id AS i, round(arg_max(value, event_id), 4) AS v FROM events GROUP BY 1")
def _(s, d):
    """The last event of each user by number, of the events table read as a stream."""
    source = T(s, d).table("events")
    stream = s.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    place = _place(s, "last")
    last = run_once(last_stream(stream.select(F.col("event_id").alias("seq"), F.col("user_id").alias("i"), F.col("value").alias("v")), "seq"), f"{place}/rows", f"{place}/state")
    return last.select("i", rounded("v", 4).alias("v"))
