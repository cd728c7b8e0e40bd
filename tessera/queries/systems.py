"""Solvers on systems with known solutions, eigenvalues, label propagation, particles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.operators import applications as app
from tessera.operators import solvers
from tessera.operators.solvers import Operator, by_solver, diagonal, divergence, iterations, residual_below, solve, stagnation, trivial
from tessera.plans.grid import Grid, Stencil, apply_stencil, stencil_matrix
from tessera.plans.matrix import Matrix
from tessera.plans.storage import cut
from tessera.plans.vector import Vector
from tessera.queries.inputs import Registry, Tables, vector_out

R = Registry()
T = Tables
#: The solution of the systems over parts.
_ANSWER = "SELECT i, v FROM answer"
_CLOSE = residual_below(1e-7, relative=True) | iterations(60)


def _solved(s, d, method: str, symmetric: bool, **options):
    """A system over all parts, of which each row has some 30 entries."""
    a = T(s, d).system if symmetric else T(s, d).skew_system
    a = Matrix(cut(a.df), a.n, a.n)
    return vector_out(solve(a, a.times(T(s, d).answer), method, **options).x)


@R.query("v10_kaczmarz_colours", "SELECT c_custkey AS i, (c_custkey % 3 + 1)::DOUBLE AS v FROM customer")
def _(s, d):
    """Each customer and the next one: a cyclic bidiagonal system, by colours of rows, which are projected onto exactly."""
    key, n = F.col("c_custkey").cast("long"), T(s, d).size("customer", "c_custkey")
    rows = T(s, d).table("customer").select(key.alias("i"), F.explode(F.array(F.struct(key.alias("j"), F.lit(8.0).alias("v")), F.struct(F.pmod(key + 1, F.lit(n)).alias("j"), F.lit(-1.0).alias("v")))).alias("e"))
    a = Matrix(cut(rows.select("i", "e.j", "e.v")), n, n)
    x = Vector(T(s, d).table("customer").select(key.alias("i"), (key % 3 + 1).cast("double").alias("v")), n)
    return vector_out(solve(a, Vector(cut(a.times(x).df), n), "kaczmarz", stop=residual_below(1e-6, relative=True) | iterations(20), blocks=None).x)


def _renumbered_grid(s, d) -> Matrix:
    """The five-point operator of a grid with a place for each part, numbered so that neighbours are far apart."""
    n = T(s, d).answer.n
    a = stencil_matrix(s, Grid((n // 40, 40)), Stencil.laplace(2, 5))
    far = lambda name: F.pmod(F.col(name) * 733, F.lit(n)).alias(name)
    return Matrix(cut(a.df.select(far("i"), far("j"), "v")), n, n)


@R.query("v11_amg", _ANSWER)
def _(s, d):
    a = _renumbered_grid(s, d)
    return vector_out(solve(a, Vector(cut(a.times(T(s, d).answer).df), a.n), "amg", stop=residual_below(1e-7, relative=True) | iterations(25), coarsest=400).x)


@R.query("v12_inverse", "SELECT s_suppkey AS i, (s_suppkey % 4 - 1.5)::DOUBLE AS v FROM supplier")
def _(s, d):
    """The system over suppliers, a full matrix, by its inverse."""
    a = T(s, d).supplier_system
    a = Matrix(cut(a.df), a.n, a.n)
    x = Vector.of(T(s, d).table("supplier"), "s_suppkey", F.col("s_suppkey") % 4 - 1.5, a.n)
    return vector_out(solve(a, a.times(x), "inverse").x)


for _n, _method, _symmetric in (("v01", "cg", True), ("v02", "bicgstab", False), ("v03", "cgs", False), ("v04", "gmres", False), ("v05", "minres", True), ("v06", "qmr", False), ("v07", "tfqmr", False), ("v08", "jacobi", False)):
    R.add(f"{_n}_{_method}", lambda s, d, m=_method, y=_symmetric: _solved(s, d, m, y, stop=_CLOSE), _ANSWER)
R.add("v01_cg_preconditioned", lambda s, d: _solved(s, d, "cg", True, stop=_CLOSE, jacobi=True), _ANSWER)
R.add("v09_richardson", lambda s, d: _solved(s, d, "richardson", True, stop=_CLOSE, omega=0.33), _ANSWER)
R.add("v10_kaczmarz", lambda s, d: _solved(s, d, "kaczmarz", False, stop=residual_below(1e-6, relative=True) | iterations(30), blocks=2), _ANSWER)
R.add("v13_decomposition", lambda s, d: _solved(s, d, "decomposition", False), _ANSWER)
R.add("v14_trivial_preconditioner", lambda s, d: _solved(s, d, "bicgstab", True, stop=_CLOSE, preconditioner=trivial), _ANSWER)
R.add("v14_solver_as_preconditioner", lambda s, d: _solved(s, d, "cg", True, stop=_CLOSE, preconditioner=by_solver("jacobi", 2, omega=0.9)), _ANSWER)
R.add("v15_relaxed", lambda s, d: _solved(s, d, "jacobi", True, stop=_CLOSE, omega=0.9), _ANSWER)


@R.query("l12_triangular_solve", "SELECT i, v FROM answer")
def _(s, d):
    """The lower triangle of the system over parts, diagonal included."""
    a = T(s, d).system
    a = Matrix(cut(a.df.filter("i >= j")), a.n, a.n)
    return vector_out(solvers.triangular_solve(a, a.times(T(s, d).answer)).x)


#: Richardson's residuals on the diagonal matrix of balances / 20000 + 1 are known: (1 - 0.5 d)^k d x.
_DIAGONAL = "SELECT c_custkey AS i, c_acctbal / 20000.0 + 1 AS d, c_custkey % 5 + 1 AS x FROM customer"
_NORMS = f"SELECT k, sqrt(sum(pow(pow(1 - 0.5 * d, k) * d * x, 2))) AS norm FROM ({_DIAGONAL}), range(9) r(k) GROUP BY k"


def _history(s, d, stop) -> list[float]:
    t = T(s, d)
    n = t.size("customer", "c_custkey")
    customer = t.table("customer")
    a = Matrix.diagonal_of(Vector.of(customer, "c_custkey", F.col("c_acctbal") / 20000.0 + 1, n))
    x = Vector.of(customer, "c_custkey", F.col("c_custkey") % 5 + 1, n)
    return solve(a, a.times(x), "richardson", stop=stop, omega=0.5).residuals


@R.query(
    "v16_stopping",
    f"WITH RECURSIVE h AS ({_NORMS}) SELECT 3::BIGINT AS counted, (SELECT min(k) FROM h WHERE norm < 0.2 * (SELECT norm FROM h WHERE k = 0)) AS relative, (SELECT min(greatest(k, 2)) FROM h WHERE norm < (SELECT norm FROM h WHERE k = 0)) AS both,"
    " (SELECT min(b.k) FROM h a JOIN h b ON a.k = b.k - 1 WHERE abs(a.norm - b.norm) < 0.7 * greatest(a.norm, b.norm)) AS stagnated, 6::BIGINT AS diverged",
)
def _(s, d):
    """Steps until criteria and their combinations stop a solver whose residuals are known."""
    steps = lambda stop: len(_history(s, d, stop)) - 1
    first = _history(s, d, iterations(0))[0]
    found = {
        "counted": steps(iterations(3)),
        "relative": steps(residual_below(0.2, relative=True) | iterations(8)),
        "both": steps((residual_below(first) & iterations(2)) | iterations(8)),
        "stagnated": steps(stagnation(1, 0.7) | iterations(8)),
        "diverged": steps((divergence(1.5) | ~divergence(0.0)) | iterations(6)),
    }
    row = T(s, d).table("region").filter("r_regionkey = 0")
    return row.select(*[F.lit(v).cast("long").alias(k) for k, v in found.items()])


@R.query("v17_constrained_least_squares", "SELECT i, round(least(v, 2.5), 1) AS v FROM known")
def _(s, d):
    """A diagonal system whose free solution lies beyond the bounds at some places: there the bounds hold."""
    known = T(s, d).known
    a = Matrix.diagonal_of(known.scalar("add", 1.0))
    n = known.n
    x = app.constrained_least_squares(a, a.times(known), Vector.fill(s, n, 0.5), Vector.fill(s, n, 2.5), tolerance=0.2, growth=30.0).x
    return vector_out(x, 1)


@R.query("v17_bounded_parts", "SELECT i, round(v, 2) AS v FROM (SELECT p_partkey AS i, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 ELSE 1.0 + p_partkey % 5 * 0.4 END::DOUBLE AS v FROM part)")
def _(s, d):
    """The system of parts over the identity, so twice as many rows as unknowns; bounds of 1 and 3 hold back two of five parts.

    The right side is made of a solution and of residuals that fulfil its optimality conditions: the
    gradient is 2 at the lower bounds, -2 at the upper ones and 0 elsewhere.
    """
    t = T(s, d)
    system = t.system
    n, part = system.n, t.table("part")
    key = F.col("p_partkey").cast("long")
    of_parts = lambda v: Vector.of(part, "p_partkey", v, n)
    x = of_parts(F.when(key % 5 == 0, 1.0).when(key % 5 == 1, 3.0).otherwise(1 + key % 5 * 0.4))
    upper = of_parts(0.05 * (key % 7 - 3))
    pull = of_parts(F.when(key % 5 == 0, 1.0).when(key % 5 == 1, -1.0).otherwise(0.0))
    lower = system.times(upper, -1.0, pull, 1.0)
    a = Matrix(cut(system.df.unionByName(part.select((key + n).alias("i"), key.alias("j"), F.lit(1.0).alias("v")))), 2 * n, n)
    residual = Vector(upper.df.unionByName(lower.df.select((F.col("i") + n).alias("i"), "v")), 2 * n)
    b = Vector(cut(a.times(x, 1.0, residual, -1.0).df), 2 * n)
    got = app.constrained_least_squares(a, b, Vector.fill(s, n, 1.0), Vector.fill(s, n, 3.0), tolerance=0.005, growth=30.0, inner=0.01)
    return vector_out(got.x, 2)


@R.query("v18_power_iteration", "SELECT i, round(sqrt(d / (SELECT sum(d) FROM degree)), 4) AS v, 1.0::DOUBLE AS value FROM degree")
def _(s, d):
    """The graph of parts with weights divided by the roots of degrees: its greatest eigenvalue is 1, with the vector of these roots."""
    near = T(s, d).near
    value, v = app.power_iteration(near, 60, 1e-12)
    return v.df.select("i", rounded("v", 4).alias("v"), rounded(F.lit(value), 4).alias("value"))


R.add("v18_power_steps", lambda s, d: vector_out(T(s, d).c.times(T(s, d).c.times(T(s, d).known)), 3), "SELECT c.i, round(sum(c.v * q.v), 3) AS v FROM c JOIN (SELECT k.i AS i, k.v AS v FROM (SELECT c.i, sum(c.v * known.v) AS v FROM c JOIN known ON c.j = known.i GROUP BY c.i) k) q ON c.j = q.i GROUP BY c.i")


@R.query("v18_inverse_iteration", "SELECT count(*) AS n, 2.0::DOUBLE AS value, true AS close FROM part")
def _(s, d):
    """The system over parts is 3 less a matrix whose greatest eigenvalue is 1: its smallest one is 2; the vector found has it to a hundredth."""
    a = T(s, d).system
    a = Matrix(cut(a.df), a.n, a.n)
    value, v = app.inverse_iteration(a, shift=1.5, steps=6, eps=1e-4, stop=residual_below(1e-4, relative=True) | iterations(30))
    off = a.times(v).plus(v, 1.0, -value).l2_norm().first()[0]
    return v.df.agg(F.count("*").alias("n"), rounded(F.lit(value), 2).alias("value"), F.lit(off < 0.01).alias("close"))


@R.query("v18_fiedler", "SELECT round(2 - 2 * cos(pi() / 8), 3) AS value FROM region WHERE r_regionkey = 0")
def _(s, d):
    """A ring of 16: the second eigenvalue of its Laplacian is 2 - 2 cos(2 pi / 16)."""
    ring = s.range(16).select(F.col("id").alias("i"), ((F.col("id") + 1) % 16).alias("j"), F.lit(1.0).alias("v"))
    value, _ = app.fiedler(Matrix(ring, 16, 16), steps=6, eps=1e-3)
    return T(s, d).table("region").filter("r_regionkey = 0").select(rounded(F.lit(value), 3).alias("value"))


@R.query("v19_label_propagation", "SELECT p_partkey AS i, k::BIGINT AS k, round(s, 2) AS v FROM (SELECT a.p_partkey, b.k, CASE WHEN a.p_partkey % 7 < 2 THEN CASE WHEN a.p_size % 2 = b.k THEN 1.0 ELSE 0.0 END ELSE b.n / b.t END AS s FROM part a JOIN (SELECT h, k, count(*) AS n, sum(count(*)) OVER (PARTITION BY h) AS t FROM (SELECT p_partkey // 7 AS h, p_size % 2 AS k FROM part WHERE p_partkey % 7 < 2) GROUP BY h, k) b ON a.p_partkey // 7 = b.h) WHERE s > 0")
def _(s, d):
    """Parts in full graphs of seven, of which two have labels: the others converge to the labels' shares."""
    part = T(s, d).table("part").select(F.col("p_partkey").alias("i"), F.floor(F.col("p_partkey") / 7).alias("h"), (F.col("p_size") % 2).cast("long").alias("k"))
    edges = part.select("i", "h").join(part.select(F.col("i").alias("j"), "h"), "h").filter("i != j").select("i", "j", F.lit(1.0).alias("v"))
    n = T(s, d).size("part", "p_partkey")
    found = app.label_propagation(Matrix(edges, n, n), part.filter("i % 7 < 2").select("i", "k"), eps=1e-4)
    return found.filter("v > 0").select("i", "k", rounded("v", 2).alias("v"))


_BODIES = "(SELECT s_suppkey AS i, 1.0 + s_suppkey % 3 AS m, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y FROM supplier)"


@R.query("v20_n_body", f"SELECT a.i, round(0.5 * sum(b.m * (b.x - a.x) / pow(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + 0.001, 1.5)), 6) AS vx, round(0.5 * sum(b.m * (b.y - a.y) / pow(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + 0.001, 1.5)), 6) AS vy FROM {_BODIES} a JOIN {_BODIES} b ON a.i <> b.i GROUP BY a.i")
def _(s, d):
    """Suppliers as bodies, over one level, on which all cells are neighbours: forces are those of all pairs."""
    key = F.col("s_suppkey").cast("long")
    at = lambda a, b: (key * a % b).cast("double")
    bodies = T(s, d).table("supplier").select(key.alias("i"), (1.0 + key % 3).alias("m"), at(37, 101).alias("x"), at(53, 97).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    return app.n_body_step(bodies, 0.5, levels=1).select("i", rounded("vx", 6).alias("vx"), rounded("vy", 6).alias("vy"))


@R.query("v21_solve_by_name", "SELECT m AS method, i, v FROM answer, (VALUES ('bicgstab'), ('minres'), ('tfqmr')) r(m)")
def _(s, d):
    a = T(s, d).system
    a = Matrix(cut(a.df), a.n, a.n)
    b = Vector(cut(a.times(T(s, d).answer).df), a.n)
    parts = [vector_out(solve(a, b, m, stop=_CLOSE).x).select(F.lit(m).alias("method"), "i", "v") for m in ("bicgstab", "minres", "tfqmr")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query("v22_residual_history", f"WITH RECURSIVE h AS ({_NORMS}) SELECT k, round(norm, 4) AS norm FROM h WHERE k <= 5")
def _(s, d):
    norms = _history(s, d, iterations(5))
    return s.createDataFrame([(k, float(x)) for k, x in enumerate(norms)], "k long, norm double").select("k", rounded("norm", 4).alias("norm"))


@R.query("f02_matrix_free_solver", _ANSWER)
def _(s, d):
    """Conjugate gradients with an operator in place of a matrix: 4 and the five-point Laplacian of a grid as large as the table of parts."""
    answer = T(s, d).answer
    grid = Grid((answer.n // 40, 40))
    product = lambda x: apply_stencil(x, grid, Stencil.laplace(2, 5)).plus(x, 1.0, 4.0)
    operator = Operator(answer.n, product, diagonal=Vector.fill(s, answer.n, 8.0))
    return vector_out(solve(operator, product(answer), "cg", stop=_CLOSE, preconditioner=diagonal).x)


@R.query("f03_own_solver", _ANSWER)
def _(s, d):
    solvers.register("damped", lambda a, b, **o: solvers.jacobi(a, b, omega=0.9, **o))
    return _solved(s, d, "damped", True, stop=_CLOSE)
