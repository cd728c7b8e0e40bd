"""Matrix products, sums, transposes, inverses, Fourier transforms and concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import complex as z
from tessera.functions.scalar import rounded
from tessera.operators import fft
from tessera.operators.factor import factorize, lu
from tessera.operators.linear import Of, OnGrid, Shift, gramian
from tessera.operators.solvers import cg, iterations, residual_below
from tessera.operators.triangular import triangular
from tessera.plans.grid import Grid, Stencil
from tessera.plans.matrix import Matrix
from tessera.plans.storage import cut
from tessera.plans.tiles import Tiles
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables, matrix_out, value_out, vector_out

R = Registry()
T = Tables

R.add("l01_gemv", lambda s, d: vector_out(T(s, d).a.times(T(s, d).p)), "SELECT o_orderkey AS i, round(coalesce(q.v, 0), 4) AS v FROM orders LEFT JOIN (SELECT a.i, sum(a.v * p.v) AS v FROM a JOIN p ON a.j = p.i GROUP BY a.i) q ON o_orderkey = q.i")
R.add("l01_gemv_transposed", lambda s, d: vector_out(T(s, d).s.times(T(s, d).p, 2.0, transposed=True)), "SELECT s.j AS i, round(2 * sum(s.v * p.v), 4) AS v FROM s JOIN p ON s.i = p.i GROUP BY s.j")


@R.query("l02_sparse_times_vectors", "SELECT s.i, e.k, round(sum(s.v * e.v), 3) AS v FROM s JOIN (SELECT s_suppkey AS i, k, s_acctbal * (k + 1) / 10 AS v FROM supplier, range(10) r(k)) e ON s.j = e.i GROUP BY s.i, e.k")
def _(s, d):
    many = T(s, d).table("supplier").select(F.col("s_suppkey").alias("i"), "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    many = many.select("i", F.col("k").cast("long").alias("k"), (F.col("s_acctbal") * (F.col("k") + 1) / 10).alias("v"))
    return T(s, d).s.times_many(many).select("i", "k", rounded("v", 3).alias("v"))


_E = "(SELECT vec_id AS i, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM embeddings) e"


def _embeddings(s, d) -> Matrix:
    rows = T(s, d).table("embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return Matrix(rows.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), T(s, d).size("embeddings", "vec_id"), 64)


def _embedding_tiles(s, d) -> Tiles:
    return Tiles.of_rows(T(s, d).table("embeddings"), "vec_id", "embedding", T(s, d).size("embeddings", "vec_id"), 64)


@R.query("l03_dense_times_sparse", f"SELECT e.j AS i, label::BIGINT AS j, round(sum(e.v), 4) AS v FROM {_E} JOIN embeddings m ON e.i = m.vec_id GROUP BY 1, 2")
def _(s, d):
    """The transposed embeddings times the table of labels, a sparse matrix: sums of embeddings by label."""
    labels = T(s, d).table("embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("v"))
    e = _embedding_tiles(s, d)
    return matrix_out(e.transpose().matmul_sparse(Matrix(labels, e.n, T(s, d).size("embeddings", "label"))).entries())


R.add("l04_spgemm_plus", lambda s, d: matrix_out(T(s, d).c.matmul(T(s, d).c, 0.5, T(s, d).c, 2.0), 3), "SELECT i, j, round(sum(v), 3) AS v FROM (SELECT l.i, r.j, 0.5 * l.v * r.v AS v FROM c l JOIN c r ON l.j = r.i UNION ALL SELECT i, j, 2 * v FROM c) GROUP BY i, j")
R.add("l05_dense_gemm", lambda s, d: matrix_out(_embedding_tiles(s, d).transpose().matmul(_embedding_tiles(s, d)).entries()), f"SELECT l.j AS i, r.j, round(sum(l.v * r.v), 4) AS v FROM {_E[:-1] + 'l'} JOIN {_E[:-1] + 'r'} ON l.i = r.i GROUP BY l.j, r.j")
R.add("l05_dense_gramian", lambda s, d: matrix_out(_embedding_tiles(s, d).gramian().entries()), R.sql["l05_dense_gemm"])
R.add("l06_matrix_plus_matrix", lambda s, d: matrix_out(T(s, d).s.plus(T(s, d).d, 2.0, -3.0)), "SELECT s.i, s.j, round(2 * s.v - 3 * coalesce(d.v, 0), 4) AS v FROM s LEFT JOIN d ON s.i = d.i AND s.j = d.j")
R.add("l07_scale", lambda s, d: matrix_out(T(s, d).s.scale(0.25)), "SELECT i, j, round(0.25 * v, 4) AS v FROM s")
R.add("l08_transpose", lambda s, d: matrix_out(T(s, d).a.transpose()), "SELECT j AS i, i AS j, round(v, 4) AS v FROM a")


@R.query("l09_conjugate", "SELECT i, j, round(v, 4) AS re, round(-v / 2, 4) AS im FROM s")
def _(s, d):
    w = z.conj(z.make(F.col("v"), F.col("v") / 2))
    return T(s, d).s.df.select("i", "j", rounded(w["re"], 4).alias("re"), rounded(w["im"], 4).alias("im"))


@R.query("l10_real_imaginary", "SELECT i, j, round(v * v - 1, 4) AS re, round(2 * v, 4) AS im FROM s")
def _(s, d):
    w = z.make(F.col("v"), F.lit(1.0))
    w = z.mult(w, w)
    return T(s, d).s.df.select("i", "j", rounded(w["re"], 4).alias("re"), rounded(w["im"], 4).alias("im"))


@R.query("l11_inverse", "SELECT a.s_suppkey::BIGINT AS i, b.s_suppkey::BIGINT AS j, CASE WHEN a.s_suppkey = b.s_suppkey THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM supplier a, supplier b")
def _(s, d):
    """The system over suppliers times its inverse: the identity."""
    a = T(s, d).supplier_system
    a = Matrix(cut(a.df), a.n, a.n)
    inverse = lu(a).inverse()
    got = Tiles.pack(a, inverse.size).matmul(inverse).filled()
    return got.entries().df.select("i", "j", (rounded("v", 6) + 0.0).alias("v"))


@R.query("l12_decomposition", "SELECT i, k, round(v * k + k - 1, 4) AS v FROM answer, (VALUES (1::BIGINT), (2)) r(k)")
def _(s, d):
    """A symmetric system over parts is factorised once, for two right sides."""
    t = T(s, d)
    a = Matrix(cut(t.system.df), t.answer.n, t.answer.n)
    factors = factorize(a, symmetric=True)
    sides = [t.answer.times_plus(k, k - 1.0) for k in (1.0, 2.0)]
    found = [factors.solve(a.times(x)).df.select("i", F.lit(k).cast("long").alias("k"), rounded("v", 4).alias("v")) for k, x in enumerate(sides, 1)]
    return found[0].unionByName(found[1])


@R.query("l12_bidiagonal_solve", "SELECT c_custkey AS i, (c_custkey % 5 + 1)::DOUBLE AS v FROM customer")
def _(s, d):
    """Each customer needs the one before: a chain through the whole table, folded in a logarithmic number of steps."""
    t = T(s, d)
    key, n = F.col("c_custkey").cast("long"), t.size("customer", "c_custkey")
    rows = t.table("customer").select(key.alias("i"), F.explode(F.array(F.struct(key.alias("j"), F.lit(2.0).alias("v")), F.struct((key - 1).alias("j"), (F.lit(-1.0) - key % 2 * 0.5).alias("v")))).alias("e"))
    a = Matrix(rows.select("i", "e.j", "e.v").filter("j >= 0"), n, n)
    x = Vector(t.table("customer").select(key.alias("i"), (key % 5 + 1).cast("double").alias("v")), n)
    return vector_out(triangular(a, a.times(x))[0])


R.add("l13_gramian", lambda s, d: vector_out(T(s, d).s.gramian_times(Vector.of(T(s, d).table("supplier"), "s_suppkey", F.col("s_acctbal") / 1000)), 3), "SELECT s.j AS i, round(sum(s.v * q.v), 3) AS v FROM s JOIN (SELECT s.i, sum(s.v * s_acctbal / 1000) AS v FROM s JOIN supplier ON s.j = s_suppkey GROUP BY s.i) q ON s.i = q.i GROUP BY s.j")
R.add("l14_hybrid_sum", lambda s, d: vector_out((Of(T(s, d).s) + Of(T(s, d).d)) @ Vector.of(T(s, d).table("supplier"), "s_suppkey", "s_acctbal")), "SELECT p.i, round(coalesce(sum(q.v * s_acctbal), 0), 4) AS v FROM p LEFT JOIN (SELECT i, j, v FROM s UNION ALL SELECT i, j, v FROM d) q ON p.i = q.i LEFT JOIN supplier ON q.j = s_suppkey GROUP BY p.i")
R.add("l15_matrix_free", lambda s, d: vector_out(OnGrid(Grid((T(s, d).b.n,)), Stencil((((0,), 3.0), ((-1,), -1.0)))) @ T(s, d).b), "SELECT b.i, round(3 * b.v - coalesce(n.v, 0), 4) AS v FROM b LEFT JOIN b n ON n.i = b.i - 1")


def _by_cg(operator, answer):
    """The solution of a system of an operator, whose right side has a known one."""
    stop = residual_below(1e-8, relative=True) | iterations(60)
    return vector_out(cg(operator.solver_operator(), Vector(cut(operator.apply(answer).df), answer.n), stop=stop).x)


@R.query("l13_gramian_system", "SELECT i, v FROM answer")
def _(s, d):
    """The Gramian of the graph of parts and twice the identity, a chain that is never made."""
    near = T(s, d).near
    near = Matrix(cut(near.df), near.n, near.m)
    return _by_cg(gramian(near) + Shift(near.n, 2.0), T(s, d).answer)


@R.query("l14_hybrid_system", "SELECT i, v FROM answer")
def _(s, d):
    """The system over parts, less a quarter of its graph's matrix, and a grid operator, as one sum."""
    t = T(s, d)
    near, system = (Matrix(cut(m.df), m.n, m.m) for m in (t.near, t.system))
    grid = OnGrid(Grid((near.n // 40, 40)), Stencil.laplace(2, 5))
    return _by_cg(Of(system) - 0.25 * Of(near) + 0.5 * grid, t.answer)


@R.query("l01_expression", "SELECT p.i, round(2 * p.v - 0.5 * coalesce(q.v, 0) - coalesce(r.v, 0) + p.v, 4) AS v FROM p LEFT JOIN (SELECT s.i, sum(s.v * s_acctbal) AS v FROM s JOIN supplier ON s.j = s_suppkey GROUP BY s.i) q ON p.i = q.i LEFT JOIN (SELECT d.i, sum(d.v * s_acctbal) AS v FROM d JOIN supplier ON d.j = s_suppkey GROUP BY d.i) r ON p.i = r.i")
def _(s, d):
    """Sums and products in one expression: one aggregate, and a join for each product."""
    t = T(s, d)
    x, p = Vector.of(t.table("supplier"), "s_suppkey", "s_acctbal"), t.p
    return vector_out((2 * p - (0.5 * t.s + t.d) @ x + p).value)


@R.query("l17_fft_vector", "WITH n AS (SELECT CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS n FROM customer), w AS (SELECT k FROM n, unnest(range(n)) u(k)) SELECT w.k AS i, round(sum(c_acctbal * cos(-2 * pi() * ((w.k * c_custkey) % n) / n)), 2) AS re, round(sum(c_acctbal * sin(-2 * pi() * ((w.k * c_custkey) % n) / n)), 2) AS im FROM w, n, customer GROUP BY w.k")
def _(s, d):
    return fft.fft_vector(T(s, d).b).select("i", rounded("re", 2).alias("re"), rounded("im", 2).alias("im"))


@R.query("l17_fft_rows", f"SELECT e.i, w.k AS j, round(sum(e.v * cos(-2 * pi() * ((w.k * e.j) % 64) / 64)), 3) + 0 AS re, round(sum(e.v * sin(-2 * pi() * ((w.k * e.j) % 64) / 64)), 3) + 0 AS im FROM {_E}, (SELECT unnest(range(64)) AS k) w GROUP BY e.i, w.k")
def _(s, d):
    found = fft.fft_rows(fft.complex_matrix(_embeddings(s, d)), 64)
    return found.select("i", "j", (rounded("re", 3) + 0.0).alias("re"), (rounded("im", 3) + 0.0).alias("im"))


@R.query("l17_fft_columns", f"WITH n AS (SELECT CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS n FROM embeddings), w AS (SELECT k, n FROM n, unnest(range(n)) u(k)) SELECT w.k AS i, e.j, round(sum(e.v * cos(-2 * pi() * ((w.k * e.i) % w.n) / w.n)), 3) + 0 AS re, round(sum(e.v * sin(-2 * pi() * ((w.k * e.i) % w.n) / w.n)), 3) + 0 AS im FROM {_E}, w GROUP BY w.k, e.j")
def _(s, d):
    m = _embeddings(s, d)
    found = fft.fft_rows(fft.complex_matrix(m), fft.next_power_of_two(m.n), dim=0)
    return found.select("i", "j", (rounded("re", 3) + 0.0).alias("re"), (rounded("im", 3) + 0.0).alias("im"))


@R.query(
    "l17_fft_2d",
    f"WITH n AS (SELECT CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS n FROM embeddings), w AS (SELECT k, n FROM n, unnest(range(n)) u(k)),"
    f" r AS (SELECT e.i, q.k AS j, sum(e.v * cos(-2 * pi() * ((q.k * e.j) % 64) / 64)) AS re, sum(e.v * sin(-2 * pi() * ((q.k * e.j) % 64) / 64)) AS im FROM {_E}, (SELECT unnest(range(64)) AS k) q GROUP BY e.i, q.k),"
    " turned AS (SELECT w.k, r.j, r.re, r.im, -2 * pi() * ((w.k * r.i) % w.n) / w.n AS a FROM r, w)"
    " SELECT k AS i, j, round(sum(re * cos(a) - im * sin(a)), 2) + 0 AS re, round(sum(re * sin(a) + im * cos(a)), 2) + 0 AS im FROM turned GROUP BY k, j",
)
def _(s, d):
    m = _embeddings(s, d)
    found = fft.fft_2d(fft.complex_matrix(m), fft.next_power_of_two(m.n), 64)
    return found.select("i", "j", (rounded("re", 2) + 0.0).alias("re"), (rounded("im", 2) + 0.0).alias("im"))


@R.query("l17_ifft_round_trip", "SELECT c_custkey AS i, round(c_acctbal, 4) AS v FROM customer")
def _(s, d):
    b = T(s, d).b
    n = fft.next_power_of_two(b.n)
    back = fft.fft(fft.fft_vector(b), n, inverse=True)
    return back.filter(F.col("i") < b.n).select("i", (rounded(F.col("re") / n, 4) + 0.0).alias("v"))


R.add("l18_replicate", lambda s, d: matrix_out(T(s, d).c.replicate(2, 3)), "SELECT c.i + 25 * p AS i, c.j + 25 * q AS j, round(c.v, 4) AS v FROM c, range(2) a(p), range(3) b(q)")
R.add("g11_replicate_diagonal", lambda s, d: matrix_out(T(s, d).c.replicate_diagonal(3)), "SELECT c.i + 25 * p AS i, c.j + 25 * p AS j, round(c.v, 4) AS v FROM c, range(3) a(p)")
R.add("l19_jacobi_sweep", lambda s, d: vector_out(T(s, d).skew_system.jacobi_step(T(s, d).answer, T(s, d).p, 0.8)), "SELECT k.i, round(0.8 * (p.v + coalesce(q.v, 0)) / 3 + 0.2 * k.v, 4) AS v FROM answer k JOIN p ON p.i = k.i LEFT JOIN (SELECT near.i, sum(near.v * CASE WHEN near.j > near.i THEN 1.5 ELSE 1 END * n.v) AS v FROM near JOIN (SELECT p_partkey AS i, (p_partkey % 3 + 1)::DOUBLE AS v FROM part) n ON near.j = n.i GROUP BY near.i) q ON k.i = q.i")
R.add("l20_blas1", lambda s, d: T(s, d).t.df.agg(rounded(F.sum("v"), 4).alias("total"), rounded(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("nrm2"), rounded(F.sum(F.abs("v")), 4).alias("total_abs")), "SELECT round(sum(v), 4) AS total, round(sqrt(sum(v * v)), 4) AS nrm2, round(sum(abs(v)), 4) AS total_abs FROM t")

R.add("c01_concat", lambda s, d: vector_out(T(s, d).p.concat(T(s, d).b)), "SELECT i, round(v, 4) AS v FROM p UNION ALL SELECT i + (SELECT max(p_partkey) + 1 FROM part), round(v, 4) FROM b")
_PARTS, _SUPPLIERS = "(SELECT max(p_partkey) + 1 FROM part)", "(SELECT max(s_suppkey) + 1 FROM supplier)"
R.add("c02_blocks_of_parts", lambda s, d: matrix_out(T(s, d).s.append_columns(T(s, d).d).append_rows(T(s, d).d.append_columns(T(s, d).s))), " UNION ALL ".join(f"SELECT i + {a} * {_PARTS} AS i, j + {b} * {_SUPPLIERS} AS j, round(v, 4) AS v FROM {m}" for a, b, m in ((0, 0, "s"), (0, 1, "d"), (1, 0, "d"), (1, 1, "s"))))
R.add("c03_columns_of_parts", lambda s, d: matrix_out(T(s, d).s.append_columns(T(s, d).d)), f"SELECT i, j, round(v, 4) AS v FROM s UNION ALL SELECT i, j + {_SUPPLIERS}, round(v, 4) FROM d")
R.add("c04_rows_of_parts", lambda s, d: matrix_out(T(s, d).s.append_rows(T(s, d).d)), f"SELECT i, j, round(v, 4) AS v FROM s UNION ALL SELECT i + {_PARTS}, j, round(v, 4) FROM d")
R.add("c02_block_layout", lambda s, d: matrix_out(T(s, d).c.append_columns(T(s, d).spd).append_rows(T(s, d).spd.append_columns(T(s, d).c))), "SELECT i, j, round(v, 4) AS v FROM c UNION ALL SELECT i, j + 25, round(v, 4) FROM spd UNION ALL SELECT i + 25, j, round(v, 4) FROM spd UNION ALL SELECT i + 25, j + 25, round(v, 4) FROM c")
R.add("c03_append_columns", lambda s, d: matrix_out(T(s, d).c.append_columns(T(s, d).spd)), "SELECT i, j, round(v, 4) AS v FROM c UNION ALL SELECT i, j + 25, round(v, 4) FROM spd")
R.add("c04_append_rows", lambda s, d: matrix_out(T(s, d).c.append_rows(T(s, d).spd)), "SELECT i, j, round(v, 4) AS v FROM c UNION ALL SELECT i + 25, j, round(v, 4) FROM spd")
R.add("c05_append_array", lambda s, d: vector_out(T(s, d).y.concat(T(s, d).z)), "SELECT i, round(v, 4) AS v FROM y UNION ALL SELECT i + (SELECT max(o_orderkey) + 1 FROM orders), round(v, 4) FROM z")
R.add("c06_append_contributions", lambda s, d: vector_out(T(s, d).y.merge(T(s, d).z, "add")), "SELECT i, round(sum(v), 4) AS v FROM (SELECT i, v FROM y UNION ALL SELECT i, v FROM z) GROUP BY i")
R.add("c08_split_and_join_columns", lambda s, d: matrix_out(T(s, d).s.part(0, T(s, d).s.n, 0, 50).append_columns(T(s, d).s.part(0, T(s, d).s.n, 50, 1 << 40))), "SELECT i, j, round(v, 4) AS v FROM s")
R.add("c09_pattern_union", lambda s, d: T(s, d).y.df.select("i").union(T(s, d).z.df.select("i")).distinct(), "SELECT i FROM y UNION SELECT i FROM z")
R.add("c09_pattern_intersection", lambda s, d: T(s, d).y.df.select("i").intersect(T(s, d).z.df.select("i")), "SELECT i FROM y INTERSECT SELECT i FROM z")
R.add("k01_diagonals", lambda s, d: T(s, d).c.per_diagonal().select("d", "n", rounded("v", 4).alias("v")), "SELECT c.j - c.i AS d, count(*) AS n, round(sum(v), 4) AS v FROM c GROUP BY 1")
R.add("k02_offsets", lambda s, d: vector_out(T(s, d).s.offsets()), "SELECT k AS i, coalesce((SELECT count(*) FROM s WHERE s.i < k), 0)::DOUBLE AS v FROM range((SELECT max(p_partkey) + 2 FROM part)) r(k)")
R.add("k03_adjacency_round_trip", lambda s, d: matrix_out(Matrix.from_adjacency(T(s, d).s.adjacency(), 0, 0)), "SELECT i, j, round(v, 4) AS v FROM s")
R.add("k04_entry_positions", lambda s, d: T(s, d).s.positions().select("i", "j", "p"), "SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS p FROM s")
R.add("k05_non_empty_rows", lambda s, d: T(s, d).a.df.select("i").distinct(), "SELECT DISTINCT i FROM a")
R.add("k06_value_of_norm", lambda s, d: value_out(T(s, d).c.max_norm()), "SELECT round(max(abs(v)), 4) AS v FROM c")
