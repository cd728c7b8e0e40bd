"""Scans, sorting, ranks, resizing and dense forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.plans.grid import transpose_flat
from tessera.plans.scan import ranked
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables, matrix_out, vector_out

R = Registry()
T = Tables

R.add("w01_scan", lambda s, d: vector_out(T(s, d).x.scan(), 2), "SELECT i, round(sum(v) OVER (ORDER BY i), 2) AS v FROM x")
R.add("w02_exclusive_scan", lambda s, d: vector_out(T(s, d).x.scan(exclusive=True), 2), "SELECT i, round(coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS v FROM x")
R.add("w03_differences", lambda s, d: vector_out(T(s, d).x.unscan()), "SELECT a.i, round(b.v - a.v, 4) AS v FROM x a JOIN x b ON b.i = a.i + 1")
R.add("w04_is_sorted", lambda s, d: T(s, d).x.scan().is_sorted(), "SELECT bool_and(v >= 0) AS ok FROM x")
R.add("w04_is_sorted_descending", lambda s, d: T(s, d).x.is_sorted(False), "SELECT bool_and(a.v >= b.v) AS ok FROM x a JOIN x b ON b.i = a.i + 1")
R.add("w05_sort_permutation", lambda s, d: vector_out(T(s, d).x.sort()[1]), "SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, i::DOUBLE AS v FROM x")
R.add("w06_inverse_permutation", lambda s, d: vector_out(T(s, d).x.sort()[1].inverse_permutation()), "SELECT i, (row_number() OVER (ORDER BY v, i) - 1)::DOUBLE AS v FROM x")
R.add("w07_scan_of_parts", lambda s, d: T(s, d).table("orders").groupBy((F.col("o_orderkey") % 16).alias("i")).agg(F.sum("o_totalprice").alias("v")).transform(lambda df: vector_out(Vector(df, 16).scan(), 2)), "SELECT i, round(sum(v) OVER (ORDER BY i), 2) AS v FROM (SELECT o_orderkey % 16 AS i, sum(o_totalprice) AS v FROM orders GROUP BY 1)")
R.add("w08_sizes_to_offsets", lambda s, d: vector_out(T(s, d).a.offsets()), "SELECT k AS i, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS v FROM (SELECT k, count(a.i) AS n FROM range((SELECT max(o_orderkey) + 2 FROM orders)) r(k) LEFT JOIN a ON a.i = k GROUP BY k)")
R.add("w09_shift", lambda s, d: vector_out(T(s, d).x.shift(3)), "SELECT (i + 3) % (SELECT max(o_orderkey) + 1 FROM orders) AS i, round(v, 4) AS v FROM x")
R.add("s01_sort", lambda s, d: vector_out(T(s, d).x.sort()[0]), "SELECT row_number() OVER (ORDER BY v) - 1 AS i, round(v, 4) AS v FROM x")
R.add("s01_sort_descending", lambda s, d: vector_out(T(s, d).x.sort(False)[0]), "SELECT row_number() OVER (ORDER BY v DESC) - 1 AS i, round(v, 4) AS v FROM x")
R.add("s02_sort_with_permutation", lambda s, d: vector_out(T(s, d).b.sort(False)[1]), "SELECT row_number() OVER (ORDER BY v DESC, i) - 1 AS i, i::DOUBLE AS v FROM b")
R.add("s03_sort_entries", lambda s, d: T(s, d).y.df.orderBy("i").select("i", rounded("v", 4).alias("v")), "SELECT i, round(v, 4) AS v FROM y")
R.add("s04_merge_runs", lambda s, d: vector_out(T(s, d).p.concat(T(s, d).b).sort()[0]), "SELECT row_number() OVER (ORDER BY v) - 1 AS i, round(v, 4) AS v FROM (SELECT v FROM p UNION ALL SELECT v FROM b)")
R.add("s05_sort_triples", lambda s, d: ranked(T(s, d).s.df, F.col("i").asc(), F.col("j").asc()).select("rank", "i", "j", rounded("v", 4).alias("v")), "SELECT row_number() OVER (ORDER BY i, j) - 1 AS rank, i, j, round(v, 4) AS v FROM s")
R.add("s06_sort_rows", lambda s, d: T(s, d).s.adjacency().select("i", F.posexplode(F.arrays_zip("js", "vs")).alias("p", "e")).select("i", F.col("p").cast("long").alias("p"), F.col("e.js").alias("j"), rounded("e.vs", 4).alias("v")), "SELECT i, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS p, j, round(v, 4) AS v FROM s")
R.add("s07_top", lambda s, d: T(s, d).x.top(25).select("i", rounded("v", 4).alias("v")), "SELECT i, round(v, 4) AS v FROM x ORDER BY v DESC, i LIMIT 25")
R.add("s08_resize_down", lambda s, d: vector_out(T(s, d).x.resize(100)), "SELECT i, round(v, 4) AS v FROM x WHERE i < 100")
R.add("s08_resize_up", lambda s, d: vector_out(T(s, d).b.resize(T(s, d).b.n + 50)), "SELECT i, round(v, 4) AS v FROM b UNION ALL SELECT (SELECT max(c_custkey) + 1 FROM customer) + k, 0 FROM range(50) r(k)")
R.add("x01_transpose_flat", lambda s, d: vector_out(transpose_flat(Vector.of(T(s, d).table("nation"), "n_nationkey", F.col("n_nationkey") * 1.5), 5, 5)), "SELECT ((i % 5) * 5 + i // 5)::BIGINT AS i, v::DOUBLE AS v FROM (SELECT n_nationkey AS i, n_nationkey * 1.5 AS v FROM nation)")
R.add("x02_compute", lambda s, d: vector_out(T(s, d).x.scalar("modulo", 1000.0)), "SELECT i, round(v % 1000, 4) AS v FROM x")
R.add("x03_sequence", lambda s, d: vector_out(Vector.linear(s, T(s, d).b.n, 5.0, -1.0)), "SELECT c_custkey AS i, (5 - c_custkey)::DOUBLE AS v FROM customer")
R.add("x04_dense_of_sparse", lambda s, d: vector_out(T(s, d).y.to_dense()), "SELECT i, round(v, 4) AS v FROM yd")


@R.query("x05_gather_groups", f"SELECT o_orderkey AS k, j, round(e.v, 4) AS v FROM orders JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM embeddings) e ON e.vec_id = o_custkey")
def _(s, d):
    """The 64 values of a vector for each index of another table, as many as it asks for."""
    rows = T(s, d).table("embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    asked = T(s, d).table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("vec_id"))
    return asked.join(rows, "vec_id").select("k", F.col("j").cast("long").alias("j"), rounded(F.col("v").cast("double"), 4).alias("v"))


R.add("x08_scatter_value", lambda s, d: vector_out(T(s, d).x.binary("mult", Vector(T(s, d).z.df.select("i", F.lit(0.0).alias("v")), T(s, d).z.n, 1.0, False))), "SELECT x.i, round(CASE WHEN z.i IS NULL THEN x.v ELSE 0 END, 4) AS v FROM x LEFT JOIN z ON x.i = z.i")
