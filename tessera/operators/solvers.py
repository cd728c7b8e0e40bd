"""Iterative solvers: a driver loop of Spark steps over one wide table (i, x, r, ...) of all their vectors.

Elementwise updates are projections; a product with the matrix is a join and a sum, after which
the table is written; all dot products that a step needs are one aggregate. The matrix is packed
into tiles once (tessera.plans.sparse), so that a step moves vectors only. Only scalars reach the driver. In place of a matrix, an Operator gives
products alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.factor import factorize, lu
from tessera.operators.triangular import triangular
from tessera.plans import storage
from tessera.plans.matrix import Matrix
from tessera.plans.sparse import Held
from tessera.plans.storage import cut, in_buckets, shuffled
from tessera.plans.tiles import SIZE, Tiles
from tessera.plans.vector import Vector

c = F.col


# -- stopping


class Criterion:
    """A test of the residual norms so far (the first is that of the start)."""

    def __init__(self, test: Callable[[list[float]], bool]):
        self.test = test

    def __call__(self, norms: list[float]) -> bool:
        return self.test(norms)

    def __and__(self, other: "Criterion") -> "Criterion":
        return Criterion(lambda n: self(n) and other(n))

    def __or__(self, other: "Criterion") -> "Criterion":
        return Criterion(lambda n: self(n) or other(n))

    def __invert__(self) -> "Criterion":
        return Criterion(lambda n: not self(n))


def iterations(k: int) -> Criterion:
    return Criterion(lambda n: len(n) - 1 >= k)


def residual_below(eps: float, relative: bool = False) -> Criterion:
    return Criterion(lambda n: n[-1] < eps * (n[0] if relative else 1.0))


def divergence(factor: float) -> Criterion:
    return Criterion(lambda n: n[-1] > factor * n[0])


def stagnation(lookback: int, eps: float) -> Criterion:
    return Criterion(lambda n: len(n) > lookback and max(n[-lookback - 1 :]) - min(n[-lookback - 1 :]) < eps * max(n[-lookback - 1 :]))


DEFAULT_STOP = residual_below(1e-9, relative=True) | residual_below(1e-14) | iterations(100)


@dataclass
class Solution:
    x: Vector
    residuals: list[float] = field(default_factory=list)

    @property
    def steps(self) -> int:
        return len(self.residuals) - 1


@dataclass(frozen=True)
class Operator:
    """A square matrix that is known by its products: product(x) and, for qmr, transposed(x) are vectors; diagonal for the Jacobi forms."""

    n: int
    product: Callable[[Vector], Vector]
    transposed: Callable[[Vector], Vector] | None = None
    diagonal: Vector | None = None


class State:
    """The vectors of a solver as columns of one table."""

    def __init__(self, matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None):
        self.n, self.watched, self.seen = matrix.n, {}, {}
        self.own = not isinstance(matrix, (Operator, Held))
        self.matrix = Held.of(matrix) if self.own else matrix
        x = (x0 or Vector.fill(b.df.sparkSession, matrix.n if isinstance(matrix, Operator) else matrix.m, 0.0)).to_dense().df
        self.df = self.written(shuffled(b.to_dense().df.select("i", c("v").alias("b")), self.n).join(x.select("i", c("v").alias("x")), "i"))

    def close(self) -> "State":
        if self.own:
            self.matrix.release()
        return self

    def solution(self, norms: list[float]) -> Solution:
        """x as it is now; what executors kept for the products is let go."""
        return Solution(self.close().vector(), norms)

    def let(self, **columns: Column | float) -> "State":
        self.df = self.df.withColumns({k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in columns.items()})
        return self

    def times(self, to: str, of: Column, transposed: bool = False) -> "State":
        """A new column: the matrix times a column expression."""
        if isinstance(self.matrix, Operator):
            product = self.matrix.transposed if transposed else self.matrix.product
            if product is None:
                raise ValueError("the operator has no product with its transpose")
            sums = product(Vector(self.df.select("i", of.alias("v")), self.n)).df.select("i", c("v").alias("__sum"))
        else:
            sums = self.matrix.sums(self.df.select("i", of.alias("v")), transposed).select("i", c("v").alias("__sum"))
        return self.join(sums, to)

    def watch(self, **columns: Column) -> "State":
        """Sums that the next table's writing finds, too: they are in seen after it."""
        self.watched, self.seen = columns, {}
        return self

    def written(self, df: DataFrame) -> DataFrame:
        """A written table; one of many rows is in buckets, so that the next join moves what is new alone."""
        if self.watched:
            found, columns, self.watched = Observation(), self.watched, {}
            held = self.written(df.observe(found, *[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in columns.items()]))
            self.seen = dict(found.get)
            return held
        if self.n <= storage.BROADCAST_ROWS:
            return cut(df)
        return in_buckets(df, "i", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def join(self, values: DataFrame, to: str) -> "State":
        """A new column, written, from values (i, __sum); 0 where there is none."""
        df = self.df.drop(to) if to in self.df.columns else self.df
        self.df = self.written(shuffled(df, self.n).join(values, "i", "left").select(*df.columns, F.coalesce("__sum", F.lit(0.0)).alias(to)))
        return self

    def sums(self, **columns: Column) -> dict[str, float]:
        row = self.df.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in columns.items()]).first()
        return row.asDict()

    def norm(self, of: Column) -> float:
        return math.sqrt(max(0.0, self.sums(s=of * of)["s"]))

    def residual(self) -> "State":
        return self.times("ax", c("x")).let(r=c("b") - c("ax"))

    def vector(self, column: str = "x") -> Vector:
        return Vector(self.df.select("i", c(column).alias("v")), self.n)

    def with_diagonal(self) -> "State":
        if isinstance(self.matrix, Operator):
            if self.matrix.diagonal is None:
                raise ValueError("the operator doesn't say its diagonal")
            d = self.matrix.diagonal.df.select("i", c("v").alias("d"))
        else:
            d = self.matrix.df.filter("i = j").select("i", c("v").alias("d"))
        self.df = self.written(shuffled(self.df, self.n).join(d, "i", "left"))
        return self


# -- preconditioners: called as p(state, to, of), they add the column to, near the matrix's inverse times the column expression of


def trivial(s: State, to: str, of: Column) -> State:
    return s.let(**{to: of})


def diagonal(s: State, to: str, of: Column) -> State:
    """Divides by the diagonal."""
    if "d" not in s.df.columns:
        s.with_diagonal()
    return s.let(**{to: of / c("d")})


def by_solver(method: str, steps: int = 2, **options) -> Callable[[State, str, Column], State]:
    """Some steps of any solver, from 0."""

    def apply(s: State, to: str, of: Column) -> State:
        rhs = Vector(cut(s.df.select("i", of.alias("v"))), s.n)
        x = solve(s.matrix, rhs, method, stop=iterations(steps), **options).x
        return s.join(x.df.select("i", c("v").alias("__sum")), to)

    apply.joins = True
    return apply


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


Preconditioner = Callable[[State, str, Column], State]
#: Sums of squares that a step makes smaller by more than this are added up anew.
CANCELLED = 1e-6


def _start(matrix: "Matrix | Operator", b: Vector, x0: Vector | None, jacobi: bool, preconditioner: Preconditioner | None) -> tuple[State, Preconditioner]:
    return State(matrix, b, x0).residual(), preconditioner or (diagonal if jacobi else trivial)


def cg(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, jacobi: bool = False, preconditioner: Preconditioner | None = None) -> Solution:
    """Conjugate gradients for a symmetric positive definite matrix; jacobi preconditions by the diagonal, preconditioner by anything (symmetric)."""
    s, pre = _start(matrix, b, x0, jacobi, preconditioner)
    pre(s, "z", c("r")).let(p=c("z"))
    got = s.sums(rho=c("r") * c("z"), rr=c("r") * c("r"))
    norms = [math.sqrt(got["rr"])]
    # the sums after a step are polynomials of its length where z is r times a column, so that the product's table gives them
    scale = F.lit(1.0) if pre is trivial else 1 / c("d") if pre is diagonal else None
    while not stop(norms) and got["rho"]:
        s.watch(pq=c("p") * c("q"))
        if scale is not None:
            s.watch(pq=c("p") * c("q"), rr=c("r") * c("r"), rq=c("r") * c("q"), qq=c("q") * c("q"), rho=c("r") * c("z"), zq=c("z") * c("q"), qz=c("q") * c("q") * scale)
        seen = s.times("q", c("p")).seen
        alpha = _ratio(got["rho"], seen["pq"])
        s.let(x=c("x") + alpha * c("p"), r=c("r") - alpha * c("q"))
        if scale is None:
            sums = {"rho": c("r") * c("z"), "rr": c("r") * c("r")}
            joins = getattr(pre, "joins", False)  # z is then written, once and last
            pre(s.watch(**sums if joins else {}), "z", c("r"))
            new = s.seen if joins else s.sums(**sums)
        else:
            pre(s, "z", c("r"))
            new = {"rho": seen["rho"] - 2 * alpha * seen["zq"] + alpha * alpha * seen["qz"], "rr": seen["rr"] - 2 * alpha * seen["rq"] + alpha * alpha * seen["qq"]}
            if not (new["rr"] > CANCELLED * seen["rr"] and new["rho"] > CANCELLED * abs(seen["rho"])):
                new = s.sums(rho=c("r") * c("z"), rr=c("r") * c("r"))
        s.let(p=c("z") + _ratio(new["rho"], got["rho"]) * c("p"))
        got = new
        norms.append(math.sqrt(max(0.0, got["rr"])))
    return s.solution(norms)


def bicgstab(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, jacobi: bool = False, preconditioner: Preconditioner | None = None) -> Solution:
    s, pre = _start(matrix, b, x0, jacobi, preconditioner)
    s.let(r0=c("r"), p=0.0, v=0.0)
    norms = [s.norm(c("r"))]
    rho_old = alpha = omega = 1.0
    while not stop(norms):
        rho = s.sums(a=c("r0") * c("r"))["a"]
        beta = _ratio(rho, rho_old) * _ratio(alpha, omega)
        pre(s.let(p=c("r") + beta * (c("p") - omega * c("v"))), "kp", c("p")).times("v", c("kp"))
        alpha = _ratio(rho, s.sums(a=c("r0") * c("v"))["a"])
        pre(s.let(s=c("r") - alpha * c("v")), "ks", c("s")).times("t", c("ks"))
        got = s.sums(ts=c("t") * c("s"), tt=c("t") * c("t"))
        omega = _ratio(got["ts"], got["tt"])
        s.let(x=c("x") + alpha * c("kp") + omega * c("ks"), r=c("s") - omega * c("t"))
        norms.append(s.norm(c("r")))
        rho_old = rho
        if not rho or not omega:
            break
    return s.solution(norms)


def cgs(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, jacobi: bool = False, preconditioner: Preconditioner | None = None) -> Solution:
    s, pre = _start(matrix, b, x0, jacobi, preconditioner)
    s.let(r0=c("r"), u=c("r"), p=c("r"))
    norms = [s.norm(c("r"))]
    rho = s.sums(a=c("r0") * c("r"))["a"]
    while not stop(norms) and rho:
        pre(s, "kp", c("p")).times("t", c("kp"))
        alpha = _ratio(rho, s.sums(a=c("r0") * c("t"))["a"])
        pre(s.let(q=c("u") - alpha * c("t")), "w", c("u") + c("q")).times("aw", c("w"))
        s.let(x=c("x") + alpha * c("w"), r=c("r") - alpha * c("aw"))
        got = s.sums(a=c("r0") * c("r"), rr=c("r") * c("r"))
        beta = _ratio(got["a"], rho)
        s.let(u=c("r") + beta * c("q")).let(p=c("u") + beta * beta * c("p") + beta * c("q"))
        rho = got["a"]
        norms.append(math.sqrt(got["rr"]))
    return s.solution(norms)


def gmres(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, krylov: int = 10, jacobi: bool = False, preconditioner: Preconditioner | None = None) -> Solution:
    """Restarted every krylov steps. A new direction is made orthogonal to all former ones twice, by one aggregate each time."""
    s, pre = _start(matrix, b, x0, jacobi, preconditioner)
    norms = [s.norm(c("r"))]
    while not stop(norms):
        pre(s, "z", c("r"))
        beta = s.norm(c("z"))
        if not beta:
            break
        scale = norms[-1] / beta
        s.let(v0=c("z") / beta)
        h: list[list[float]] = []
        rotations: list[tuple[float, float]] = []
        g = [beta]
        for k in range(krylov):
            pre(s.times("aw", c(f"v{k}")), "w", c("aw"))
            column = [0.0] * (k + 1)
            for _ in range(2):
                got = s.sums(**{f"h{m}": c("w") * c(f"v{m}") for m in range(k + 1)})
                w = c("w")
                for m in range(k + 1):
                    column[m] += got[f"h{m}"]
                    w = w - got[f"h{m}"] * c(f"v{m}")
                s.let(w=w)
            length = s.norm(c("w"))
            column.append(length)
            for m, (cs, sn) in enumerate(rotations):
                column[m], column[m + 1] = cs * column[m] + sn * column[m + 1], -sn * column[m] + cs * column[m + 1]
            r = math.hypot(column[k], column[k + 1])
            cs, sn = (column[k] / r, column[k + 1] / r) if r else (1.0, 0.0)
            rotations.append((cs, sn))
            column[k], column[k + 1] = r, 0.0
            h.append(column)
            g.append(-sn * g[k])
            g[k] *= cs
            norms.append(abs(g[k + 1]) * scale)
            if stop(norms) or not length or length < 1e-14 * beta:
                break
            s.let(**{f"v{k + 1}": c("w") / length})
        y = [0.0] * len(h)
        for m in reversed(range(len(h))):
            y[m] = _ratio(g[m] - sum(h[n][m] * y[n] for n in range(m + 1, len(h))), h[m][m])
        x = c("x")
        for m, f in enumerate(y):
            x = x + f * c(f"v{m}")
        s.df = s.df.select("i", "b", x.alias("x"), *(["d"] if "d" in s.df.columns else []))
        s.residual()
        norms[-1] = s.norm(c("r"))
    return s.solution(norms)


def minres(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP) -> Solution:
    """For symmetric matrices, also indefinite ones: Lanczos vectors and two Givens rotations a step."""
    s = State(matrix, b, x0).residual()
    beta = s.norm(c("r"))
    norms = [beta]
    s.let(v=(c("r") / beta) if beta else 0.0, v_old=0.0, p=0.0, p_old=0.0)
    zeta, beta_k = beta, 0.0
    c1, s1, c2, s2 = 1.0, 0.0, 1.0, 0.0
    while not stop(norms) and beta:
        s.times("w", c("v"))
        alpha = s.sums(a=c("w") * c("v"))["a"]
        s.let(w=c("w") - alpha * c("v") - beta_k * c("v_old"))
        beta_new = s.norm(c("w"))
        rho3 = s2 * beta_k
        rho2 = c1 * c2 * beta_k + s1 * alpha
        rho1_hat = c1 * alpha - s1 * c2 * beta_k
        rho1 = math.hypot(rho1_hat, beta_new)
        c2, s2 = c1, s1
        c1, s1 = (rho1_hat / rho1, beta_new / rho1) if rho1 else (1.0, 0.0)
        s.let(p_new=(c("v") - rho2 * c("p") - rho3 * c("p_old")) / rho1 if rho1 else F.lit(0.0))
        s.let(x=c("x") + c1 * zeta * c("p_new"), p_old=c("p"), v_old=c("v")).let(p=c("p_new"), v=c("w") / beta_new if beta_new else F.lit(0.0))
        zeta *= -s1
        beta_k = beta_new
        norms.append(abs(zeta))
        if not beta_new or not rho1:
            break
    return s.solution(norms)


def qmr(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP) -> Solution:
    """Quasi-minimal residuals by two-sided Lanczos; needs products with the transposed matrix."""
    s = State(matrix, b, x0).residual()
    s.let(v=c("r"), w=c("r"), p=0.0, q=0.0, d=0.0, s=0.0)
    rho = xi = s.norm(c("r"))
    norms = [rho]
    gamma, eta, eps, theta = 1.0, -1.0, 0.0, 0.0
    first = True
    while not stop(norms) and rho and xi:
        s.let(v=c("v") / rho, w=c("w") / xi)
        delta = s.sums(a=c("v") * c("w"))["a"]
        if not delta:
            break
        if first:
            s.let(p=c("v"), q=c("w"))
        else:
            s.let(p=c("v") - xi * delta / eps * c("p"), q=c("w") - rho * delta / eps * c("q"))
        s.times("ap", c("p"))
        eps = s.sums(a=c("q") * c("ap"))["a"]
        beta = eps / delta
        if not eps or not beta:
            break
        s.let(v=c("ap") - beta * c("v"))
        rho_new = s.norm(c("v"))
        s.times("aq", c("q"), transposed=True).let(w=c("aq") - beta * c("w"))
        xi = s.norm(c("w"))
        gamma_old, theta_old = gamma, theta
        theta = rho_new / (gamma_old * abs(beta))
        gamma = 1 / math.sqrt(1 + theta * theta)
        eta = -eta * rho * gamma * gamma / (beta * gamma_old * gamma_old)
        keep = 0.0 if first else (theta_old * gamma) ** 2
        s.let(d=eta * c("p") + keep * c("d"), s=eta * c("ap") + keep * c("s"))
        s.let(x=c("x") + c("d"), r=c("r") - c("s"))
        rho, first = rho_new, False
        norms.append(s.norm(c("r")))
    return s.solution(norms)


def tfqmr(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP) -> Solution:
    """Transpose-free quasi-minimal residuals; two half steps an iteration."""
    s = State(matrix, b, x0).residual()
    s.let(w=c("r"), y=c("r"), rt=c("r"), d=0.0).times("ay", c("y")).let(v=c("ay"))
    tau = s.norm(c("r"))
    norms = [tau]
    theta = eta = 0.0
    rho = tau * tau
    while not stop(norms) and rho:
        sigma = s.sums(a=c("rt") * c("v"))["a"]
        if not sigma:
            break
        alpha = rho / sigma
        for half in (0, 1):
            if half:
                s.let(y=c("y") - alpha * c("v")).times("ay", c("y"))
            s.let(w=c("w") - alpha * c("ay"), d=c("y") + theta * theta * eta / alpha * c("d"))
            theta = _ratio(s.norm(c("w")), tau)
            cos = 1 / math.sqrt(1 + theta * theta)
            tau *= theta * cos
            eta = cos * cos * alpha
            s.let(x=c("x") + eta * c("d"))
        norms.append(tau)
        if stop(norms):
            break
        rho_new = s.sums(a=c("rt") * c("w"))["a"]
        beta = rho_new / rho
        s.let(ay_old=c("ay"), y=c("w") + beta * c("y")).times("ay", c("y")).let(v=c("ay") + beta * (c("ay_old") + beta * c("v")))
        rho = rho_new
    return s.solution(norms)


def jacobi(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, omega: float = 1.0) -> Solution:
    """x + omega * D^-1 (b - A x): the Jacobi sweep written with the residual."""
    s = State(matrix, b, x0).with_diagonal().residual()
    norms = [s.norm(c("r"))]
    while not stop(norms):
        s.let(x=c("x") + omega * c("r") / c("d")).residual()
        norms.append(s.norm(c("r")))
    return s.solution(norms)


def richardson(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, omega: float = 1.0) -> Solution:
    s = State(matrix, b, x0).residual()
    norms = [s.norm(c("r"))]
    while not stop(norms):
        s.let(x=c("x") + omega * c("r")).residual()
        norms.append(s.norm(c("r")))
    return s.solution(norms)


def row_colours(matrix: Matrix) -> tuple[DataFrame, int]:
    """((i, colour), number of colours): rows of one colour share no column.

    In each round the rows that have the greatest priority (a hash) in all their columns get its
    colour: an aggregate over columns and one over rows, so that no pairs of rows are made.
    """
    rows = cut(matrix.df.select("i", "j"))
    open_, parts = cut(rows.select("i").distinct().withColumn("h", F.xxhash64("i"))), []
    while not open_.isEmpty():
        held = rows.join(open_, "i")
        first = held.groupBy("j").agg(F.max(F.struct("h", "i")).alias("m"))
        chosen = cut(held.join(first, "j").groupBy("i").agg(F.bool_and(c("m.i") == c("i")).alias("ok")).filter("ok").select("i", F.lit(len(parts)).alias("colour")))
        parts.append(chosen)
        open_ = cut(open_.join(chosen, "i", "left_anti"))
    colours = matrix.df.sparkSession.range(0).select(c("id").alias("i"), F.lit(0).alias("colour"))
    for p in parts:
        colours = colours.unionByName(p)
    return cut(colours), len(parts)


#: Blocks of a sweep that are one plan: each is two products, and a written table follows the last.
CHAINED = 8
#: Entries of a partition below which it isn't worth another one.
DEALT_ROWS = 1 << 18


def kaczmarz(matrix: "Matrix | Operator", b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, omega: float = 1.0, blocks: int | None = 1) -> Solution:
    """Projections onto rows, block of rows after block; rows of one block (equal remainders by blocks) are projected onto at once.

    With one block a sweep is Cimmino's form, with as many as there are rows it is the row-by-row
    order. Without blocks (None) they are the colours of row_colours(): rows of one colour share no
    column, so that projecting onto them at once is exactly what doing so one by one is. A block is
    one product with its rows and one with their transpose, and reads these alone. Up to CHAINED
    blocks are one plan without a branch: x goes along as rows of the identity below the block's
    (numbers below 0), so that a product reads what the one before it gave once. Vectors of up to
    BROADCAST_ROWS values are sent to the entries, which are dealt by what they add to, so that
    products aren't shuffled; longer ones meet entries that are dealt by what they join. Where a
    sweep makes the residual larger, omega is halved.
    """
    if isinstance(matrix, Operator):
        raise ValueError("projections need the rows of a matrix")
    n = matrix.m
    entries = Matrix(cut(matrix.df.select("i", "j", "v")), matrix.n, matrix.m)
    rows = entries.df.groupBy("i").agg(F.sum(c("v") * c("v")).alias("aa")).filter("aa > 0").join(b.to_dense().df.select("i", c("v").alias("b")), "i")
    if blocks is None:
        colours, blocks = row_colours(entries)
        rows = rows.join(colours.withColumnRenamed("colour", "block"), "i")
    else:
        rows = rows.withColumn("block", F.pmod(c("i"), F.lit(blocks)).cast("int"))
    held = cut(entries.df.join(shuffled(cut(rows), matrix.n), "i"))
    right = cut(b.to_dense().df.select(c("i").alias("to"), (-c("v")).alias("y")))
    chained, sent = blocks <= CHAINED, n + matrix.n <= storage.BROADCAST_ROWS
    most = int(matrix.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, 1 + (held.count() + n) // DEALT_ROWS)
    same = matrix.df.sparkSession.range(n).select(c("id").alias("at"), (-1 - c("id")).alias("to"), F.lit(1.0).alias("e"))
    forth, back = {}, {}

    def block(k: int) -> tuple[DataFrame, DataFrame]:
        """The products' entries: (at, to, e) and (at, to, base, e), of which the second gives base + e * y where at is a row, else y."""
        mine = held.filter(c("block") == k)
        there = mine.select(c("j").alias("at"), c("i").alias("to"), c("v").alias("e"))
        again = mine.select(c("i").alias("at"), c("j").alias("to"), (c("v") * c("b") / c("aa")).alias("base"), (-c("v") / c("aa")).alias("e"))
        if chained:
            there = there.unionByName(same)
            again = again.unionByName(same.select(c("to").alias("at"), c("at").alias("to"), F.lit(0.0).alias("base"), "e"))
        return there, again

    def dealt(entries: DataFrame) -> DataFrame:
        by = "to" if sent else "at"
        return entries.repartition(parts, by).sortWithinPartitions(by).persist(StorageLevel.MEMORY_AND_DISK)

    def product(of: DataFrame, x: DataFrame, value: Column) -> DataFrame:
        return of.join(x.select(c("to").alias("at"), "y").hint("broadcast" if sent else "merge"), "at").select("to", value.alias("y"))

    def projected(x: DataFrame, k: int) -> DataFrame:
        there, again = (forth[k], back[k]) if chained else block(k)
        sums = product(there, x, c("e") * c("y")).groupBy("to").agg(F.sum("y").alias("y"))
        moved = product(again, sums, F.when(c("at") < 0, c("y")).otherwise(F.lit(omega) * (c("base") + c("e") * c("y"))))
        return (moved if chained else moved.unionByName(x)).groupBy("to").agg(F.sum("y").alias("y"))

    def residual(x: DataFrame) -> float:
        rest = product(all_, x, c("e") * c("y")).unionByName(right).groupBy("to").agg(F.sum("y").alias("y"))
        return math.sqrt(rest.agg(F.coalesce(F.sum(c("y") * c("y")), F.lit(0.0)).alias("s")).first().s)

    if chained:
        for k in range(blocks):
            forth[k], back[k] = map(dealt, block(k))
    all_ = dealt(entries.df.select(c("j").alias("at"), c("i").alias("to"), c("v").alias("e")))
    x = cut((x0 or Vector.fill(b.df.sparkSession, n, 0.0)).to_dense().df.select(c("i").alias("to"), c("v").alias("y")))
    norms = [residual(x)]
    while not stop(norms):
        for k in range(blocks):
            x = projected(x, k)
            if not chained or k == blocks - 1:
                x = cut(x)
        norms.append(residual(x))
        if norms[-1] > norms[-2]:
            omega /= 2
    for kept in (all_, *forth.values(), *back.values()):
        kept.unpersist()
    return Solution(Vector(x.select(c("to").alias("i"), c("y").alias("v")), n), norms)


def inverse(matrix: Matrix, size: int | None = None) -> Matrix:
    """The inverse of a regular matrix, by its factors over tiles; a singular one is an error."""
    return lu(matrix, size).inverse().entries()


def inverse_solve(matrix: Matrix, b: Vector, size: int | None = None) -> Solution:
    found = lu(matrix, size).inverse()
    return Solution(found.matmul(Tiles.of_vector(b, found.size)).vector(), [])


def triangular_solve(matrix: Matrix, b: Vector, lower: bool = True, size: int = SIZE) -> Solution:
    """The solution of a triangular system; entries on the other side of the diagonal are not read.

    Chains of rows take as many steps as the logarithm of their length, rows that need many others a
    step for each tile of rows.
    """
    return Solution(triangular(matrix, b, lower, size)[0], [])


def decomposition_solve(matrix: Matrix, b: Vector, symmetric: bool = False, size: int | None = None) -> Solution:
    """LU with pivoting, or LDL^T of a symmetric matrix; factorize() keeps the factors for further right sides."""
    return Solution(factorize(matrix, symmetric, size).solve(b), [])


def amg(matrix: Matrix, b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, **options) -> Solution:
    """Multigrid cycles; see tessera.operators.multigrid, which has them as a preconditioner, too."""
    from tessera.operators import multigrid

    return multigrid.amg(matrix, b, x0, stop, **options)


SOLVERS: dict[str, Callable[..., Solution]] = {
    "cg": cg, "bicgstab": bicgstab, "cgs": cgs, "gmres": gmres, "minres": minres, "qmr": qmr, "tfqmr": tfqmr, "jacobi": jacobi,
    "richardson": richardson, "kaczmarz": kaczmarz, "amg": amg, "inverse": inverse_solve, "decomposition": decomposition_solve, "triangular": triangular_solve,
}


def register(name: str, solver: Callable[..., Solution]) -> None:
    """Make a solver of one's own known to solve()."""
    SOLVERS[name] = solver


def solve(matrix: "Matrix | Operator", b: Vector, method: str = "cg", **options) -> Solution:
    return SOLVERS[method](matrix, b, **options)
