"""Sums, norms, reductions and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.operators.assembly import assemble_matrix, assemble_vector, disassemble, scatter_onto, size_of
from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables, matrix_out, value_out, vector_out

R = Registry()
T = Tables

R.add("a01_sum", lambda s, d: value_out(T(s, d).x.sum(), 2), "SELECT round(sum(v), 2) AS v FROM x")
R.add("a01_sum_sparse_zero", lambda s, d: value_out(T(s, d).y.scalar("add", 3.0).sum(), 2), "SELECT round(sum(v + 3), 2) AS v FROM yd")
R.add("a02_min", lambda s, d: value_out(T(s, d).y.reduce("min")), "SELECT round(min(v), 4) AS v FROM yd")
R.add("a03_max", lambda s, d: value_out(T(s, d).y.unary("minus").reduce("max")), "SELECT round(max(-v) + 0, 4) + 0 AS v FROM yd")
R.add("a04_l1_norm", lambda s, d: value_out(T(s, d).t.l1_norm()), "SELECT round(sum(abs(v)), 4) AS v FROM t")
R.add("a05_l2_norm", lambda s, d: value_out(T(s, d).t.l2_norm()), "SELECT round(sqrt(sum(v * v)), 4) AS v FROM t")
R.add("a06_max_norm", lambda s, d: value_out(T(s, d).t.max_norm()), "SELECT round(max(abs(v)), 4) AS v FROM t")
R.add("a07_max_diff_norm", lambda s, d: value_out(T(s, d).t.max_diff_norm(T(s, d).y)), "SELECT round(max(abs(t.v - yd.v)), 4) AS v FROM t JOIN yd ON t.i = yd.i")
R.add("a08_dot", lambda s, d: value_out(T(s, d).t.dot(T(s, d).y)), "SELECT round(sum(t.v * yd.v), 4) AS v FROM t JOIN yd ON t.i = yd.i")
R.add("a08_dot_sparse", lambda s, d: value_out(T(s, d).y.dot(T(s, d).z)), "SELECT round(sum(y.v * z.v), 4) AS v FROM y JOIN z ON y.i = z.i")
for _op, _e in (("add", "sum(v)"), ("min", "min(v)"), ("max", "max(v)"), ("abs_max", "max(abs(v))")):
    R.add(f"a09_reduce_{_op}", lambda s, d, op=_op: value_out(T(s, d).t.reduce(op)), f"SELECT round({_e}, 4) AS v FROM t")
R.add("a09_reduce_mult", lambda s, d: value_out(Vector.of(T(s, d).table("nation"), "n_nationkey", F.col("n_nationkey") / 20 + 0.5).reduce("mult"), 6), "SELECT round(product(n_nationkey / 20 + 0.5), 6) AS v FROM nation")
R.add("a10_zip_reduce", lambda s, d: value_out(T(s, d).t.reduce2(T(s, d).y, "abs_diff", "max")), "SELECT round(max(abs(t.v - yd.v)), 4) AS v FROM t JOIN yd ON t.i = yd.i")
for _dim, _key, _base in ((0, "i", "parts"), (1, "j", "suppliers")):
    _all = "(SELECT i AS k FROM p)" if _dim == 0 else "(SELECT s_suppkey AS k FROM supplier)"
    for _op, _before, _e in (("add", "sqr", "sum(v * v)"), ("max", "copy", "max(v)"), ("add", "abs", "sum(abs(v))")):
        R.add(
            f"a11_reduce_{_base}_{_op}_{_before}",
            lambda s, d, dim=_dim, op=_op, before=_before: vector_out(Vector(T(s, d).s.reduce(dim, op, before).df.filter(F.abs("v") < float("inf")), 0)),
            f"SELECT k AS i, round(coalesce(v, 0), 4) AS v FROM {_all} {'LEFT JOIN' if _op == 'add' else 'JOIN'} (SELECT {_key}, {_e} AS v FROM s GROUP BY 1) q ON q.{_key} = k",
        )
R.add("a11_reduce_compat", lambda s, d: vector_out(T(s, d).s.reduce(0, "min", compat=True)), "SELECT i, 0.0::DOUBLE AS v FROM p")
R.add("a12_matrix_norms", lambda s, d: T(s, d).s.df.agg(rounded(F.sum(F.abs("v")), 2).alias("l1"), rounded(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("l2"), F.max(F.abs("v")).alias("mx")), "SELECT round(sum(abs(v)), 2) AS l1, round(sqrt(sum(v * v)), 4) AS l2, max(abs(v)) AS mx FROM s")
R.add("a13_matrix_max_diff", lambda s, d: value_out(T(s, d).s.max_diff_norm(T(s, d).d)), "SELECT round(max(abs(s.v - coalesce(d.v, 0))), 4) AS v FROM s LEFT JOIN d ON s.i = d.i AND s.j = d.j")


@R.query("a14_norms_of_both", "SELECT round(sum(abs(v)), 4) AS l1, round(sqrt(sum(v * v)), 4) AS l2, round(max(abs(v)), 4) AS mx FROM b")
def _(s, d):
    b = T(s, d).b
    return b.df.agg(rounded(F.sum(F.abs("v")), 4).alias("l1"), rounded(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("l2"), rounded(F.max(F.abs("v")), 4).alias("mx"))


R.add("a15_argmax_abs", lambda s, d: T(s, d).t.argmax_abs().select("i", rounded("v", 4).alias("v")), "SELECT i, round(abs(v), 4) AS v FROM t ORDER BY abs(v) DESC, i LIMIT 1")
R.add("a16_max_and_min_place", lambda s, d: T(s, d).x.df.agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("hi"), F.min_by("i", F.struct("v", "i")).alias("lo")), "SELECT (SELECT i FROM x ORDER BY v DESC, i LIMIT 1) AS hi, min(i) AS lo FROM x WHERE v = (SELECT min(v) FROM x)")
R.add("a17_buckets", lambda s, d: Vector.of(T(s, d).table("customer"), "c_custkey", "c_nationkey").histogram(20), 'SELECT b, size, (sum(size) OVER (ORDER BY b) - size)::BIGINT AS "offset" FROM (SELECT k AS b, count(c_custkey) AS size FROM range(20) r(k) LEFT JOIN customer ON c_nationkey = k GROUP BY 1)')
R.add("a18_combine_repeats", lambda s, d: vector_out(Vector.combined(T(s, d).table("events"), "user_id", "value", 0, "min")), "SELECT user_id AS i, round(min(value), 4) AS v FROM events GROUP BY 1")
R.add("a19_unique_triples", lambda s, d: matrix_out(Matrix.combined(T(s, d).table("lineitem"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_extendedprice"), 0, 0, "max")), "SELECT l_suppkey AS i, l_partkey AS j, round(max(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2")


def _events(s, d):
    return T(s, d).table("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("i"), F.col("value").alias("v"))


for _op, _e in (("add", "sum(value)"), ("max", "max(value)"), ("copy", "arg_max(value, event_id)")):
    R.add(f"a20_assemble_vector_{_op}", lambda s, d, op=_op: vector_out(assemble_vector(_events(s, d), size_of(_events(s, d)), op)), f"SELECT user_id AS i, round({_e}, 4) AS v FROM events GROUP BY 1")
R.add("a20_assemble_onto", lambda s, d: vector_out(scatter_onto(T(s, d).b, _events(s, d), "add")), "SELECT b.i, round(b.v + coalesce(q.v, 0), 4) AS v FROM b LEFT JOIN (SELECT user_id AS i, sum(value) AS v FROM events GROUP BY 1) q ON b.i = q.i")


def _lines(s, d):
    return T(s, d).table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_tax").alias("v"))


R.add("a21_assemble_matrix", lambda s, d: matrix_out(assemble_matrix(_lines(s, d), 0, 0, "add", T(s, d).d)), "SELECT coalesce(d.i, q.i) AS i, coalesce(d.j, q.j) AS j, round(coalesce(d.v, 0) + coalesce(q.v, 0), 4) AS v FROM d FULL JOIN (SELECT l_partkey AS i, l_suppkey AS j, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2) q ON d.i = q.i AND d.j = q.j")
R.add("a22_sparsity", lambda s, d: T(s, d).s.sparsity().select("nnz", rounded("rate", 6).alias("rate")), "SELECT count(*) AS nnz, round(count(*) / ((SELECT max(p_partkey) + 1 FROM part) * (SELECT max(s_suppkey) + 1 FROM supplier)), 6) AS rate FROM s")
R.add("a23_row_sizes", lambda s, d: vector_out(T(s, d).a.row_sizes()), "SELECT i, count(*)::DOUBLE AS v FROM a GROUP BY i")
R.add("a24_collective_sums", lambda s, d: T(s, d).x.df.withColumn("owner", F.col("i") % 5).groupBy("owner").agg(F.sum("v").alias("s"), F.max("v").alias("m")).agg(rounded(F.sum("s"), 2).alias("s"), F.max("m").alias("m"), F.count("*").alias("n")), "SELECT round(sum(v), 2) AS s, max(v) AS m, 5::BIGINT AS n FROM x")
R.add("c07_disassemble", lambda s, d: disassemble(T(s, d).y, 100).select("i", rounded("v", 4).alias("v")), "SELECT i + 100 AS i, round(v, 4) AS v FROM y WHERE v <> 0")
