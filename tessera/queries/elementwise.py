"""Generators, unary and binary functions, vector expressions, points and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import complex as z
from tessera.functions.scalar import BINARY, UNARY, rounded
from tessera.operators import generate
from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables, matrix_out, value_out, vector_out

R = Registry()
T = Tables

# -- unary functions, dense and sparse

_UNARY_SQL = {
    "copy": "v", "conj": "v", "abs": "abs(v)", "asum": "abs(v)", "sqr": "v * v", "minus": "-v", "exp": "exp(v)", "sqrt": "CASE WHEN v < 0 THEN 'NaN'::DOUBLE ELSE sqrt(v) END",
    "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "atan": "atan(v)", "log": "CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END",
    "floor": "floor(v)", "ceil": "ceil(v)", "sign": "sign(v)::DOUBLE", "reciprocal": "1 / v",
}
for _n, _op in enumerate(UNARY, 1):
    R.add(f"u{_n:02d}_{_op}", lambda s, d, op=_op: vector_out(T(s, d).t.unary(op)), f"SELECT i, round({_UNARY_SQL[_op]}, 4) AS v FROM t")
R.add("u18_sparse_cos", lambda s, d: vector_out(T(s, d).y.unary("cos").to_dense()), "SELECT i, round(cos(v), 4) AS v FROM yd")

# -- binary functions of a dense and a sparse vector, and with a number

_BINARY_SQL = {
    "copy": "b", "add": "a + b", "sub": "a - b", "mult": "a * b", "divide": "CASE WHEN b <> 0 THEN a / b WHEN a > 0 THEN 'Infinity'::DOUBLE WHEN a < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END",
    "modulo": "CASE WHEN b <> 0 THEN a % b ELSE 'NaN'::DOUBLE END", "min": "least(a, b)", "max": "greatest(a, b)", "abs_max": "greatest(abs(a), abs(b))", "abs_diff": "abs(a - b)", "pow": "pow(a, b)", "copy_sign": "abs(a) * CASE WHEN b < 0 THEN -1 ELSE 1 END",
}
for _n, _op in enumerate(BINARY, 1):
    if _op == "pow":
        R.add(f"b{_n:02d}_pow", lambda s, d: vector_out(T(s, d).t.unary("abs").binary("pow", T(s, d).z.to_dense())), "SELECT t.i, round(pow(abs(t.v), coalesce(z.v, 0)), 4) AS v FROM t LEFT JOIN z ON t.i = z.i")
    else:
        R.add(f"b{_n:02d}_{_op}", lambda s, d, op=_op: vector_out(T(s, d).t.binary(op, T(s, d).y)), f"SELECT i, round({_BINARY_SQL[_op]}, 4) AS v FROM (SELECT t.i, t.v AS a, yd.v AS b FROM t JOIN yd ON t.i = yd.i)")
R.add("b13_scalar_left", lambda s, d: vector_out(T(s, d).x.scalar("divide", 1e6, swap=True)), "SELECT i, round(1e6 / v, 4) AS v FROM x")

# -- expressions

R.add("e01_scale", lambda s, d: vector_out(T(s, d).x.scalar("mult", 0.5)), "SELECT i, round(0.5 * v, 4) AS v FROM x")
R.add("e02_scale_and_add_sparse", lambda s, d: vector_out(T(s, d).y.times_plus(2.0, 3.0).to_dense()), "SELECT i, round(2 * v + 3, 4) AS v FROM yd")
R.add("e03_sum_of_two", lambda s, d: vector_out(T(s, d).x.plus(T(s, d).y, 0.01, -2.0)), "SELECT x.i, round(0.01 * x.v - 2 * yd.v, 4) AS v FROM x JOIN yd ON x.i = yd.i")
R.add("e04_product", lambda s, d: vector_out(T(s, d).t.binary("mult", T(s, d).y).scalar("mult", 3.0)), "SELECT t.i, round(3 * (t.v * yd.v), 4) AS v FROM t JOIN yd ON t.i = yd.i")
R.add("e05_update_add", lambda s, d: vector_out(T(s, d).x.binary("add", T(s, d).z).binary("sub", T(s, d).y)), "SELECT x.i, round(x.v + coalesce(z.v, 0) - yd.v, 4) AS v FROM x JOIN yd ON x.i = yd.i LEFT JOIN z ON x.i = z.i")
R.add("e06_quotient", lambda s, d: vector_out(T(s, d).y.to_dense().binary("divide", T(s, d).x)), "SELECT x.i, round(yd.v / x.v, 4) AS v FROM x JOIN yd ON x.i = yd.i")
R.add("e07_min_max_pow", lambda s, d: vector_out(T(s, d).t.scalar("min", 1.0).scalar("max", -1.0).scalar("pow", 2.0)), "SELECT i, round(pow(greatest(least(v, 1), -1), 2), 4) AS v FROM t")
R.add("e08_cast", lambda s, d: vector_out(T(s, d).x.unary("floor").cast("long")), "SELECT i, floor(v)::BIGINT::DOUBLE AS v FROM x")


def _complex(s, d):
    t, y = T(s, d).t, T(s, d).y.to_dense()
    return t.df.select("i", F.col("v").alias("a")).join(y.df.select("i", F.col("v").alias("b")), "i").select("i", z.make(F.col("a"), F.col("b")).alias("z"))


@R.query("e09_real_and_imaginary", "SELECT t.i, round(t.v * t.v - yd.v * yd.v, 4) AS re, round(2 * t.v * yd.v, 4) AS im FROM t JOIN yd ON t.i = yd.i")
def _(s, d):
    sq = z.mult(F.col("z"), F.col("z"))
    return _complex(s, d).select("i", rounded(sq["re"], 4).alias("re"), rounded(sq["im"], 4).alias("im"))


@R.query("e10_complex_of_two", "SELECT t.i, round(sqrt(t.v * t.v + yd.v * yd.v), 4) AS r, round(atan2(yd.v, t.v), 4) AS phi FROM t JOIN yd ON t.i = yd.i")
def _(s, d):
    return _complex(s, d).select("i", rounded(z.absolute(F.col("z")), 4).alias("r"), rounded(z.arg(F.col("z")), 4).alias("phi"))


R.add("e11_axpy", lambda s, d: vector_out(T(s, d).x.plus(T(s, d).x, 1.0, 0.5)), "SELECT i, round(v + 0.5 * v, 4) AS v FROM x")
R.add("e12_scale_add_scalar", lambda s, d: vector_out(T(s, d).x.times_plus(0.01, 7.0)), "SELECT i, round(0.01 * v + 7, 4) AS v FROM x")


@R.query("e13_scalar_arithmetic", "SELECT x.i, round(x.v * 100 / m, 4) AS v FROM x, (SELECT max(v) AS m FROM x)")
def _(s, d):
    x = T(s, d).x
    return vector_out(x.scalar("mult", 100 / x.max_norm().first()[0]))


R.add("e14_assign_copy", lambda s, d: vector_out(T(s, d).x.binary("copy", T(s, d).y)), "SELECT i, round(v, 4) AS v FROM yd")


@R.query("x06_complex_arithmetic", "SELECT t.i, round(t.v / (t.v * t.v + yd.v * yd.v), 4) AS re, round(-yd.v / (t.v * t.v + yd.v * yd.v) + 0, 4) + 0 AS im FROM t JOIN yd ON t.i = yd.i WHERE t.v * t.v + yd.v * yd.v <> 0")
def _(s, d):
    q = z.divide(z.make(F.lit(1.0), F.lit(0.0)), F.col("z"))
    return _complex(s, d).filter(z.norm(F.col("z")) != 0).select("i", rounded(q["re"], 4).alias("re"), (rounded(q["im"] + 0.0, 4) + 0.0).alias("im"))


# -- generators


def _n(s, d):
    return T(s, d).size("orders", "o_orderkey")


R.add("g01_fill", lambda s, d: vector_out(Vector.fill(s, _n(s, d), 2.5)), "SELECT o_orderkey AS i, 2.5::DOUBLE AS v FROM orders")
R.add("g02_zero_matrix", lambda s, d: matrix_out(Matrix.empty(s, 5, 5)), "SELECT 0::BIGINT AS i, 0::BIGINT AS j, 0.0::DOUBLE AS v FROM region WHERE r_regionkey < 0")
R.add("g03_linear", lambda s, d: vector_out(Vector.linear(s, _n(s, d), 3.0, 0.5)), "SELECT o_orderkey AS i, 3 + 0.5 * o_orderkey AS v FROM orders")
R.add("g04_by_function", lambda s, d: vector_out(Vector.by_function(s, _n(s, d), lambda i: F.sin(i / 100))), "SELECT o_orderkey AS i, round(sin(o_orderkey / 100), 4) AS v FROM orders")


@R.query("g05_random", "SELECT count(*) AS n, true AS inside, true AS even FROM orders")
def _(s, d):
    v = generate.random_vector(s, _n(s, d), 10.0, 3)
    return v.df.agg(F.count("*").alias("n"), F.bool_and((F.col("v") >= 0) & (F.col("v") < 10)).alias("inside"), (F.abs(F.avg("v") - 5) < 0.5).alias("even"))


@R.query("g06_random_sparse", "SELECT true AS close, true AS inside FROM region WHERE r_regionkey = 0")
def _(s, d):
    n = _n(s, d)
    v = generate.random_sparse(s, n, 0.2, 1.0, 0.0, 5)
    return v.df.agg((F.abs(F.count("*") / n - 0.2) < 0.05).alias("close"), F.bool_and(F.col("i").between(0, n - 1)).alias("inside"))


R.add("g07_identity", lambda s, d: matrix_out(Matrix.identity(s, _n(s, d))), "SELECT o_orderkey AS i, o_orderkey AS j, 1.0::DOUBLE AS v FROM orders")
R.add("g08_diagonal", lambda s, d: matrix_out(Matrix.diagonal_of(T(s, d).p)), "SELECT i, i AS j, round(v, 4) AS v FROM p")


@R.query("g09_random_matrix", "SELECT true AS close, true AS inside FROM region WHERE r_regionkey = 0")
def _(s, d):
    m = generate.random_matrix(s, 2000, 500, 0.01, 9)
    inside = F.col("i").between(0, 1999) & F.col("j").between(0, 499)
    return m.df.agg((F.abs(F.count("*") / 1e6 - 0.01) < 0.001).alias("close"), F.bool_and(inside).alias("inside"))


R.add("g13_sparse_from_pairs", lambda s, d: vector_out(Vector.combined(T(s, d).table("events"), "user_id", "value", T(s, d).size("events", "user_id"), "max")), "SELECT user_id AS i, round(max(value), 4) AS v FROM events GROUP BY 1")
R.add("x07_random_seeded", lambda s, d: generate.random_vector(s, _n(s, d), 6, 1, integer=True).df.agg(F.min("v").alias("low"), F.max("v").alias("high")), "SELECT 0.0::DOUBLE AS low, 6.0::DOUBLE AS high FROM region WHERE r_regionkey = 0")

# -- predicates, points, sections

_COMPARE_SQL = {"lt": "<", "le": "<=", "ge": ">=", "gt": ">", "eq": "=", "ne": "<>"}
for _op, _sign in _COMPARE_SQL.items():
    R.add(f"p02_all_{_op}_scalar", lambda s, d, op=_op: T(s, d).x.all_scalar(op, 250000.0), f"SELECT bool_and(v {_sign} 250000) AS ok FROM x")
R.add("p01_compare", lambda s, d: T(s, d).x.df.filter(F.col("v") > 400000).select("i", rounded("v", 4).alias("v")), "SELECT i, round(v, 4) AS v FROM x WHERE v > 400000")
R.add("p03_all_vector", lambda s, d: T(s, d).x.all_vector("gt", T(s, d).y), "SELECT bool_and(x.v > yd.v) AS ok FROM x JOIN yd ON x.i = yd.i")
R.add("p03_all_sparse_vectors", lambda s, d: T(s, d).z.all_vector("le", T(s, d).y), "SELECT bool_and(coalesce(z.v, 0) <= yd.v) AS ok FROM yd LEFT JOIN z ON z.i = yd.i")
R.add("p04_compress", lambda s, d: vector_out(T(s, d).y.to_dense().to_sparse()), "SELECT i, round(v, 4) AS v FROM yd WHERE abs(v) > 1e-9")
R.add("p05_count_non_zeros", lambda s, d: T(s, d).y.to_dense().to_sparse().df.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM yd WHERE v <> 0")
R.add("p06_matrix_compress", lambda s, d: matrix_out(T(s, d).a.compress(40.0)), "SELECT i, j, round(v, 4) AS v FROM a WHERE abs(v) > 40")
R.add("p07_get_value", lambda s, d: value_out(T(s, d).y.get(17)), "SELECT round(coalesce(max(v), 0), 4) AS v FROM yd WHERE i = 17")
R.add("p08_set_value", lambda s, d: vector_out(T(s, d).y.put(3, 5.0, "add").to_dense()), "SELECT i, round(CASE WHEN i = 3 THEN v + 5 ELSE v END, 4) AS v FROM yd")
R.add("p09_matrix_get", lambda s, d: value_out(T(s, d).c.get(3, 4)), "SELECT round(coalesce(max(v), 0), 4) AS v FROM c WHERE i = 3 AND j = 4")
R.add("p09_matrix_put", lambda s, d: matrix_out(T(s, d).c.put(3, 4, 2.0, "mult")), "SELECT i, j, round(CASE WHEN i = 3 AND j = 4 THEN 2 * v ELSE v END, 4) AS v FROM c")
R.add("p10_row", lambda s, d: vector_out(T(s, d).s.row(7)), "SELECT j AS i, round(v, 4) AS v FROM s WHERE i = 7")
R.add("p11_column", lambda s, d: vector_out(T(s, d).s.column(7)), "SELECT i, round(v, 4) AS v FROM s WHERE j = 7")
R.add("p12_set_row", lambda s, d: matrix_out(T(s, d).c.put_row(2, T(s, d).known, "add")), "SELECT c.i, c.j, round(CASE WHEN c.i = 2 THEN c.v + known.v ELSE c.v END, 4) AS v FROM c JOIN known ON c.j = known.i")
R.add("p12_set_column", lambda s, d: matrix_out(T(s, d).c.put_column(2, T(s, d).known)), "SELECT c.i, c.j, round(CASE WHEN c.j = 2 THEN known.v ELSE c.v END, 4) AS v FROM c JOIN known ON c.i = known.i")
R.add("p12_set_row_of_parts", lambda s, d: matrix_out(T(s, d).near.put_row(2, T(s, d).answer, "add")), "SELECT near.i, near.j, round(CASE WHEN near.i = 2 THEN near.v + answer.v ELSE near.v END, 4) AS v FROM near JOIN answer ON near.j = answer.i")
R.add("p12_set_column_of_parts", lambda s, d: matrix_out(T(s, d).near.put_column(2, T(s, d).answer)), "SELECT near.i, near.j, round(CASE WHEN near.j = 2 THEN answer.v ELSE near.v END, 4) AS v FROM near JOIN answer ON near.i = answer.i")
R.add("p13_diagonal", lambda s, d: vector_out(T(s, d).c.diagonal()), "SELECT i, round(v, 4) AS v FROM c WHERE i = j")
R.add("p13_set_diagonal", lambda s, d: matrix_out(T(s, d).c.put_diagonal(1.0)), "SELECT i, j, round(CASE WHEN i = j THEN 1 ELSE v END, 4) AS v FROM c")
R.add("p13_set_diagonal_vector", lambda s, d: matrix_out(T(s, d).c.put_diagonal(T(s, d).known)), "SELECT c.i, c.j, round(CASE WHEN c.i = c.j THEN known.v ELSE c.v END, 4) AS v FROM c JOIN known ON c.i = known.i")
_SYSTEM = "(SELECT i, j, -v AS v FROM near UNION ALL SELECT p_partkey, p_partkey, 3.0 FROM part)"
R.add("p13_set_diagonal_of_parts", lambda s, d: matrix_out(T(s, d).system.put_diagonal(T(s, d).answer)), f"SELECT q.i, q.j, round(CASE WHEN q.i = q.j THEN answer.v ELSE q.v END, 4) AS v FROM {_SYSTEM} q JOIN answer ON q.i = answer.i")
R.add("p15_symmetry_of_parts", lambda s, d: T(s, d).system.is_symmetric().withColumn("skewed", F.lit(False)).unionByName(T(s, d).skew_system.is_symmetric().withColumn("skewed", F.lit(True))), f"SELECT skewed, bool_and(coalesce(l.v * CASE WHEN skewed AND l.j > l.i THEN 1.5 ELSE 1 END = r.v * CASE WHEN skewed AND r.j > r.i THEN 1.5 ELSE 1 END, false)) AS ok FROM (VALUES (false), (true)) k(skewed), {_SYSTEM} l LEFT JOIN {_SYSTEM} r ON l.i = r.j AND l.j = r.i GROUP BY skewed")
R.add("p20_diagonal_of_parts", lambda s, d: T(s, d).system.has_diagonal(), f"SELECT count(*) FILTER (i = j) = (SELECT count(*) FROM part) AS ok FROM {_SYSTEM}")
R.add("p14_valid_indexes", lambda s, d: T(s, d).table("lineitem").agg(F.bool_and(F.col("l_partkey").between(0, T(s, d).size("part", "p_partkey") - 1)).alias("ok")), "SELECT bool_and(l_partkey BETWEEN 0 AND (SELECT max(p_partkey) FROM part)) AS ok FROM lineitem")
R.add("p15_check_symmetry", lambda s, d: T(s, d).spd.is_symmetric(), "SELECT bool_and(l.v = r.v) AS ok FROM spd l JOIN spd r ON l.i = r.j AND l.j = r.i")
R.add("p16_consistent", lambda s, d: T(s, d).y.consistent(), "SELECT bool_and(i >= 0) AND count(*) = count(DISTINCT i) AS ok FROM y")


@R.query("p17_find_positions", "SELECT b.i, n.n_nationkey::BIGINT AS at FROM b JOIN customer ON c_custkey = b.i LEFT JOIN nation n ON n.n_nationkey = c_nationkey AND n.n_regionkey = 1")
def _(s, d):
    wanted = T(s, d).table("customer").select(F.col("c_custkey").alias("i"), F.col("c_nationkey").alias("k"))
    sorted_ = T(s, d).table("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("long").alias("at"))
    return wanted.join(sorted_, "k", "left").select("i", "at")


R.add("p18_insert", lambda s, d: vector_out(Vector(T(s, d).y.df.filter("i % 5 != 0"), T(s, d).y.n, 0.0, False).merge(Vector(T(s, d).y.df.filter("i % 5 = 0"), T(s, d).y.n, 0.0, False), "add")), "SELECT i, round(v, 4) AS v FROM y")
R.add("p19_section", lambda s, d: vector_out(T(s, d).x.section(5, 7, 200)), "SELECT ((i - 5) // 7)::BIGINT AS i, round(v, 4) AS v FROM x WHERE i >= 5 AND i < 5 + 1400 AND (i - 5) % 7 = 0")
R.add("p19_set_section", lambda s, d: vector_out(T(s, d).x.put_section(5, 7, T(s, d).known, "add")), "SELECT x.i, round(x.v + coalesce(known.v, 0), 4) AS v FROM x LEFT JOIN known ON known.i * 7 + 5 = x.i")
R.add("p20_has_diagonal", lambda s, d: T(s, d).spd.has_diagonal(), "SELECT count(*) FILTER (i = j) = (SELECT count(*) FROM nation) AS ok FROM spd")
R.add("p20_different_patterns", lambda s, d: T(s, d).s.same_pattern(T(s, d).d), "SELECT (SELECT count(*) FROM (SELECT i, j FROM s EXCEPT SELECT i, j FROM d)) + (SELECT count(*) FROM (SELECT i, j FROM d EXCEPT SELECT i, j FROM s)) = 0 AS ok")
R.add("p20_same_pattern", lambda s, d: T(s, d).spd.same_pattern(T(s, d).gen), "SELECT true AS ok FROM region WHERE r_regionkey = 0")


R.add("e03_expression", lambda s, d: vector_out((2 * T(s, d).x + 3 * T(s, d).y - T(s, d).z / 4).value), "SELECT x.i, round(2 * x.v + 3 * coalesce(y.v, 0) - coalesce(z.v, 0) / 4, 4) AS v FROM x LEFT JOIN y ON x.i = y.i LEFT JOIN z ON x.i = z.i")
