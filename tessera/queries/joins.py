"""Elementwise joins, gather and scatter, products as joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.plans.grid import Grid, Stencil, apply_stencil
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables, matrix_out, vector_out

R = Registry()
T = Tables

R.add("j01_dense_dense", lambda s, d: vector_out(T(s, d).x.binary("mult", T(s, d).t)), "SELECT x.i, round(x.v * t.v, 4) AS v FROM x JOIN t ON x.i = t.i")
R.add(
    "j02_sparse_sparse",
    lambda s, d: vector_out(T(s, d).y.scalar("add", 1.0).binary("sub", T(s, d).z.scalar("add", 2.0)).to_dense()),
    "SELECT yd.i, round(yd.v + 1 - (coalesce(z.v, 0) + 2), 4) AS v FROM yd LEFT JOIN z ON yd.i = z.i",
)
R.add("j03_same_pattern", lambda s, d: vector_out(T(s, d).y.binary("add", T(s, d).y.unary("sqr"), same_pattern=True)), "SELECT i, round(v + v * v, 4) AS v FROM y")
R.add("j04_sparse_sum", lambda s, d: vector_out(T(s, d).y.plus(T(s, d).z, 2.0, -1.0)), "SELECT y.i, round(2 * y.v - coalesce(z.v, 0), 4) AS v FROM y LEFT JOIN z ON y.i = z.i")
R.add("j05_sparse_times_dense", lambda s, d: vector_out(T(s, d).y.binary("mult", T(s, d).t)), "SELECT y.i, round(y.v * t.v, 4) AS v FROM y JOIN t ON y.i = t.i")
R.add("j06_copy_merge", lambda s, d: vector_out(Vector(T(s, d).x.df.join(T(s, d).z.df.withColumnRenamed("v", "y"), "i", "left").select("i", F.coalesce("y", "v").alias("v")), 0)), "SELECT x.i, round(coalesce(z.v, x.v), 4) AS v FROM x LEFT JOIN z ON x.i = z.i")
R.add("j07_merge_sparse", lambda s, d: vector_out(T(s, d).y.merge(T(s, d).z, "max")), "SELECT i, round(max(v), 4) AS v FROM (SELECT i, v FROM y UNION ALL SELECT i, v FROM z) GROUP BY i")


def _index(s, d):
    """For each order the number of its customer."""
    return Vector.of(T(s, d).table("orders"), "o_orderkey", "o_custkey")


R.add("j08_gather", lambda s, d: vector_out(T(s, d).b.gather(_index(s, d))), "SELECT o_orderkey AS i, round(b.v, 4) AS v FROM orders JOIN b ON o_custkey = b.i")


@R.query("j09_sparse_gather", "SELECT o_orderkey AS i, round(coalesce(n.v, 0), 4) AS v FROM orders LEFT JOIN (SELECT o_custkey AS k, count(*)::DOUBLE AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) n ON o_custkey = n.k")
def _(s, d):
    t = T(s, d)
    counts = Vector.combined(t.table("orders").filter("o_orderstatus = 'F'").withColumn("one", F.lit(1.0)), "o_custkey", "one", t.size("customer", "c_custkey"))
    return vector_out(counts.gather(_index(s, d)))


R.add("j10_scatter_add", lambda s, d: vector_out(T(s, d).b.scatter(_index(s, d), T(s, d).x, "add")), "SELECT b.i, round(b.v + coalesce(sum(o_totalprice), 0), 4) AS v FROM b LEFT JOIN orders ON o_custkey = b.i GROUP BY b.i, b.v")
R.add("j10_scatter_copy", lambda s, d: vector_out(T(s, d).b.scatter(_index(s, d), T(s, d).x, "copy")), "SELECT b.i, round(coalesce(l.v, b.v), 4) AS v FROM b LEFT JOIN (SELECT o_custkey AS i, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) l ON b.i = l.i")


@R.query("j11_gather_by_plan", "SELECT o_orderkey AS i, round(b.v - c_nationkey, 4) AS v FROM orders JOIN b ON o_custkey = b.i JOIN customer ON c_custkey = b.i")
def _(s, d):
    plan = _index(s, d)
    nations = Vector.of(T(s, d).table("customer"), "c_custkey", "c_nationkey")
    return vector_out(T(s, d).b.gather(plan).binary("sub", nations.gather(plan)))


R.add("j12_matrix_vector", lambda s, d: vector_out(T(s, d).a.times(T(s, d).p, 2.0, T(s, d).x, -0.5)), "SELECT x.i, round(coalesce(q.v, 0) * 2 - 0.5 * x.v, 4) AS v FROM x LEFT JOIN (SELECT a.i, sum(a.v * p.v) AS v FROM a JOIN p ON a.j = p.i GROUP BY a.i) q ON x.i = q.i")
R.add("j13_vector_matrix", lambda s, d: vector_out(T(s, d).a.times(T(s, d).x, transposed=True)), "SELECT p.i, round(coalesce(q.v, 0), 4) AS v FROM p LEFT JOIN (SELECT a.j, sum(a.v * x.v) AS v FROM a JOIN x ON a.i = x.i GROUP BY a.j) q ON p.i = q.j")
R.add("j14_matrix_matrix", lambda s, d: matrix_out(T(s, d).s.transpose().matmul(T(s, d).s)), "SELECT l.j AS i, r.j, round(sum(l.v * r.v), 4) AS v FROM s l JOIN s r ON l.i = r.i GROUP BY l.j, r.j")
R.add("j15_scale_rows", lambda s, d: matrix_out(T(s, d).a.scale_rows(T(s, d).t)), "SELECT a.i, a.j, round(a.v * t.v, 4) AS v FROM a JOIN t ON a.i = t.i")
R.add("j15_scale_columns", lambda s, d: matrix_out(T(s, d).a.scale_columns(T(s, d).p)), "SELECT a.i, a.j, round(a.v * p.v, 4) AS v FROM a JOIN p ON a.j = p.i")
for _op, _e in (("add", "a + b"), ("mult", "a * b"), ("max", "greatest(a, b)"), ("sub", "a - b")):
    R.add(
        f"j16_matrix_{_op}",
        lambda s, d, op=_op: matrix_out(T(s, d).s.binary(op, T(s, d).d)),
        f"SELECT i, j, round({_e}, 4) AS v FROM (SELECT s.i, s.j, s.v AS a, coalesce(d.v, 0) AS b FROM s LEFT JOIN d ON s.i = d.i AND s.j = d.j)",
    )


@R.query("j17_sorted_merge", "SELECT row_number() OVER (ORDER BY v, w, i) - 1 AS rank, i, w FROM (SELECT i, v, 0 AS w FROM p UNION ALL SELECT i, v, 1 AS w FROM b)")
def _(s, d):
    from tessera.plans.scan import ranked

    both = T(s, d).p.df.withColumn("w", F.lit(0)).unionByName(T(s, d).b.df.withColumn("w", F.lit(1)))
    return ranked(both, F.col("v").asc(), F.col("w").asc(), F.col("i").asc()).select("rank", "i", "w")


@R.query("j18_stencil", "SELECT x.i, round(2 * x.v - coalesce(l.v, 0) - coalesce(r.v, 0), 4) AS v FROM x LEFT JOIN x l ON l.i = x.i - 1 LEFT JOIN x r ON r.i = x.i + 1")
def _(s, d):
    x = T(s, d).x
    return vector_out(apply_stencil(x, Grid((x.n,)), Stencil.laplace(1, 3)))


@R.query("j19_owner_lookup", "SELECT c_nationkey % 4 AS owner, count(*) AS n, round(sum(v), 4) AS v FROM b JOIN customer ON c_custkey = b.i GROUP BY 1")
def _(s, d):
    from tessera.plans.partition import by_lookup

    owners = T(s, d).table("customer").select(F.col("c_custkey").alias("i"), (F.col("c_nationkey") % 4).alias("owner"))
    return by_lookup(T(s, d).b, owners).groupBy("owner").agg(F.count("*").alias("n"), rounded(F.sum("v"), 4).alias("v"))


@R.query("j20_exchange", "SELECT o_custkey % 7 AS target, count(*) AS n, round(sum(o_totalprice), 2) AS v, max(o_orderkey) AS last FROM orders GROUP BY 1")
def _(s, d):
    rows = T(s, d).table("orders").select((F.col("o_custkey") % 7).alias("target"), "o_orderkey", "o_totalprice").repartition(7, "target")
    return rows.groupBy("target").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("v"), F.max("o_orderkey").alias("last"))
