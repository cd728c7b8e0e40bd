"""Algorithms composed of vector and matrix operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.solvers import Criterion, Operator, Solution, State, c, cg, iterations, residual_below
from tessera.plans.grid import Grid
from tessera.plans.matrix import Matrix
from tessera.plans.sparse import Held
from tessera.plans.storage import cut
from tessera.plans.vector import Vector


def label_propagation(graph: Matrix, labels: DataFrame, eps: float = 1e-5, max_steps: int = 50) -> DataFrame:
    """(i, k, v): the share of label k at vertex i, spread along the edges; vertices of labels (i, k) keep theirs.

    Rows of the graph are normalised; a step is a sparse product, a normalisation and the clamping,
    until no share changes by eps or more.
    """
    sums = graph.df.groupBy("i").agg(F.sum("v").alias("s"))
    weights = cut(graph.df.join(sums, "i").filter("s != 0").select("i", "j", (F.col("v") / F.col("s")).alias("w")))
    fixed = cut(labels.select("i", "k", F.lit(1.0).alias("v")).distinct())
    known = fixed.select("i").distinct()
    now = fixed
    for _ in range(max_steps):
        spread = weights.join(now.select(F.col("i").alias("j"), "k", "v"), "j").groupBy("i", "k").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        free = spread.join(known, "i", "left_anti")
        total = free.groupBy("i").agg(F.sum("v").alias("t"))
        new = cut(free.join(total, "i").select("i", "k", (F.col("v") / F.col("t")).alias("v")).unionByName(fixed))
        diff = new.select("i", "k", F.col("v").alias("x")).join(now.select("i", "k", F.col("v").alias("y")), ["i", "k"], "full")
        change = diff.agg(F.coalesce(F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.lit(0.0))).first()[0]
        now = new
        if change < eps:
            break
    return now


def power_iteration(matrix: Matrix, steps: int = 50, eps: float = 1e-10) -> tuple[float, Vector]:
    """(greatest eigenvalue by absolute value, its vector of length 1)."""
    s = State(matrix, Vector.fill(matrix.df.sparkSession, matrix.n, 0.0), Vector.fill(matrix.df.sparkSession, matrix.n, 1 / math.sqrt(matrix.n)))
    value = 0.0
    for _ in range(steps):
        s.times("y", c("x"))
        got = s.sums(xy=c("x") * c("y"), yy=c("y") * c("y"))
        if not got["yy"]:
            return 0.0, s.vector()
        s.let(x=c("y") / math.sqrt(got["yy"]))
        if abs(got["xy"] - value) < eps * abs(got["xy"]):
            return got["xy"], s.vector()
        value = got["xy"]
    return value, s.vector()


def inverse_iteration(matrix: Matrix, shift: float = 0.0, steps: int = 20, eps: float = 1e-10, stop: Criterion | None = None) -> tuple[float, Vector]:
    """(the eigenvalue nearest to the shift, its vector) of a symmetric matrix that is positive definite after the shift."""
    spark = matrix.df.sparkSession
    moved = matrix if not shift else matrix.plus(Matrix.identity(spark, matrix.n), 1.0, -shift)
    moved = Held.of(moved)
    x = Vector(spark.range(matrix.n).select(F.col("id").alias("i"), (1.0 + (F.col("id") % 3)).alias("v")), matrix.n)
    value = math.inf
    for _ in range(steps):
        length = x.l2_norm().first()[0]
        x = Vector(cut(x.scalar("mult", 1 / length).df), matrix.n)
        y = cg(moved, x, stop=stop or residual_below(1e-9) | iterations(200)).x
        got = y.dot(x).first()[0]
        x, last, value = y, value, 1 / got
        if abs(value - last) < eps * abs(value):
            break
    moved.release()
    return value + shift, x.scalar("mult", 1 / x.l2_norm().first()[0])


def fiedler(graph: Matrix, steps: int = 30, eps: float = 1e-6) -> tuple[float, Vector]:
    """(second smallest eigenvalue, its vector) of the Laplacian of a connected graph: inverse iteration orthogonal to the constant vector."""
    spark, n = graph.df.sparkSession, graph.n
    e = graph.edges()
    both = cut(e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))))
    degree = both.groupBy("i").agg(F.count("*").cast("double").alias("v"))
    rows = both.select("i", "j", F.lit(-1.0).alias("v")).unionByName(degree.select("i", F.col("i").alias("j"), "v"))
    lap = Matrix(cut(rows), n, n)
    x = Vector(spark.range(n).select(F.col("id").alias("i"), (F.col("id") - F.lit((n - 1) / 2)).cast("double").alias("v")), n)
    value = math.inf
    for _ in range(steps):
        s, q = x.df.agg(F.sum("v"), F.sum(F.col("v") * F.col("v"))).first()
        length = math.sqrt(q - s * s / n)
        x = Vector(cut(x.df.select("i", ((F.col("v") - s / n) / length).alias("v"))), n)
        y = cg(lap, x, stop=residual_below(1e-7) | iterations(200)).x
        x, last, value = y, value, 1 / y.dot(x).first()[0]
        if abs(value - last) < eps * abs(value):
            break
    length = x.l2_norm().first()[0]
    return value, x.scalar("mult", 1 / length)


def constrained_least_squares(matrix: Matrix, b: Vector, low: Vector, high: Vector, tolerance: float = 1e-6, max_steps: int = 60, growth: float = 2.0, inner: float = 1e-8) -> Solution:
    """The least |A x - b| with low < x < high, by an interior point method.

    Newton directions of tau |A x - b|^2 less the logarithms of the distances to the bounds are
    found by conjugate gradients on the Gramian plus a diagonal, of which only products are taken; a step is halved until it stays
    inside and descends, and tau grows while the duality gap is too wide. With a greater inner
    (the part of its right side that a direction may leave), directions are those of a truncated
    Newton method: more steps with fewer products each.
    """
    n = matrix.m
    a = Held.of(matrix)
    bounds = cut(low.df.select("i", c("v").alias("lo")).join(high.df.select("i", c("v").alias("hi")), "i"))
    x = bounds.select("i", ((c("lo") + c("hi")) / 2).alias("x"))
    r = Vector(cut(a.times(Vector(x.select("i", c("x").alias("v")), n), 1.0, b, -1.0).df), matrix.n)
    squares = Vector(cut(a.reduce(1, "add", "sqr").df), n)
    right = b.df.select("i", c("v").alias("b"))
    tau, gaps = 1.0, []
    for _ in range(max_steps):
        g = a.times(r, 2.0, transposed=True).df.select("i", c("v").alias("g"))
        over, under = 1 / (c("hi") - c("x")), 1 / (c("x") - c("lo"))
        at = cut(x.join(bounds, "i").join(g, "i").withColumns({"slack": under - over, "h": under * under + over * over}))
        dual = at.agg(F.sum(F.greatest("g", F.lit(0.0)) * c("lo") - F.greatest(-c("g"), F.lit(0.0)) * c("hi"))).first()[0]
        rr, rb = r.df.join(right, "i", "left").agg(F.sum(c("v") * c("v")), F.coalesce(F.sum(c("v") * c("b")), F.lit(0.0))).first()
        gap = rr - (-rr - 2 * rb + dual)
        gaps.append(gap)
        if gap <= tolerance * max(1.0, rr):
            break
        hess = Vector(at.select("i", c("h").alias("v")), n)
        rhs = Vector(at.select("i", (F.lit(-tau) * c("g") + c("slack")).alias("v")), n)
        product = lambda p, h=hess, f=2 * tau: a.times(a.times(p), f, p.binary("mult", h), 1.0, transposed=True)
        gram = Operator(n, product, diagonal=squares.plus(hess, 2 * tau, 1.0))
        d = cut(cg(gram, rhs, stop=residual_below(inner, True) | residual_below(1e-12) | iterations(2 * n + 20), jacobi=True).x.df)
        moved = cut(a.times(Vector(d, n)).df.select("i", c("v").alias("m")))
        rm, mm = r.df.join(moved, "i").agg(F.sum(c("v") * c("m")), F.sum(c("m") * c("m"))).first()
        step = _line(at.join(d.select("i", c("v").alias("d")), "i"), tau, rm, mm)
        x = cut(at.select("i", "x").join(d, "i").select("i", (c("x") + F.lit(step) * c("v")).alias("x")))
        r = Vector(cut(r.df.join(moved, "i").select("i", (c("v") + F.lit(step) * c("m")).alias("v"))), matrix.n)
        if step >= 0.5:
            tau = max(growth * min(2 * n / gap, tau), tau)
    a.release()
    return Solution(Vector(x.select("i", c("x").alias("v")), n), gaps)


def _line(at: DataFrame, tau: float, rm: float, mm: float, many: int = 8) -> float:
    """The first of the steps 1, 1/2, 1/4, ... along d that stays between the bounds and descends; so many of them are tried by one aggregate.

    The squares along the line are a parabola of its two products, so only the logarithms are summed.
    """
    slope = F.sum((F.lit(tau) * c("g") - c("slack")) * c("d")).alias("slope")
    now = F.sum(F.ln(c("x") - c("lo")) + F.ln(c("hi") - c("x"))).alias("now")
    for first in range(0, 34, many):
        tried = []
        for k in range(first, first + many):
            below, above = c("x") + F.lit(0.5**k) * c("d") - c("lo"), c("hi") - c("x") - F.lit(0.5**k) * c("d")
            inside = (below > 0) & (above > 0)
            tried += [F.bool_and(inside).alias(f"in{k}"), F.sum(F.when(inside, F.ln(below) + F.ln(above))).alias(f"logs{k}")]
        got = at.agg(slope, now, *tried).first()
        for k in range(first, first + many):
            s = 0.5**k
            if got[f"in{k}"] and tau * (2 * s * rm + s * s * mm) - got[f"logs{k}"] + got["now"] <= 0.01 * s * got["slope"]:
                return s
    return 0.5**34


def mandelbrot(spark: SparkSession, width: int, height: int, steps: int = 50, area: tuple[float, float, float, float] = (-2.0, 1.0, -1.0, 1.0)) -> tuple[Vector, Grid]:
    """For each point of a grid the step after which z -> z^2 + c leaves the circle of radius 2 (steps if it doesn't), by one fold in the projection."""
    x0, x1, y0, y1 = area
    grid = Grid((height, width))
    at = grid.dims(F.col("id"))
    cx, cy = F.lit(x0) + at[1] * F.lit((x1 - x0) / width), F.lit(y0) + at[0] * F.lit((y1 - y0) / height)
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("k"))

    def step(z, _):
        out = z["x"] * z["x"] + z["y"] * z["y"] > 4
        return F.when(out, z).otherwise(F.struct((z["x"] * z["x"] - z["y"] * z["y"] + F.col("cx")).alias("x"), (2 * z["x"] * z["y"] + F.col("cy")).alias("y"), (z["k"] + 1).alias("k")))

    rows = spark.range(grid.size).select(F.col("id").alias("i"), cx.alias("cx"), cy.alias("cy"))
    return Vector(rows.select("i", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)["k"].cast("double").alias("v")), grid.size), grid


#: Places of a cell whose pairs with those around it are one group of a task.
PAIRED = 256


def n_body_step(bodies: DataFrame, dt: float, softening: float = 1e-3, levels: int = 5) -> DataFrame:
    """bodies (i, m, x, y, vx, vy) after a step under gravity with constant 1.

    The square around all bodies is halved levels times. Bodies in neighbouring cells of the finest
    level attract one another singly. At each level the cells that are no neighbours, but whose
    parents are, act by their mass and centre: at most 27 rows a body and level, joined by cell.
    Bodies at one place are pulled alike and act as one, so pairs are those of different places; the
    places of a cell are dealt over tasks by PAIRED.
    """
    low_x, low_y, high_x, high_y = bodies.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    side = max(high_x - low_x, high_y - low_y, 1e-9) * (1 + 1e-9)
    bodies = cut(bodies)
    at = cut(bodies.groupBy("x", "y").agg(F.sum("m").alias("m")))

    def cell(v: str, low: float, level: int):
        return F.floor((c(v) - low) / (side / 2**level)).cast("long")

    def pull(rows: DataFrame) -> DataFrame:
        dx, dy = c("xk") - c("x"), c("yk") - c("y")
        rr = dx * dx + dy * dy + softening
        r = rr * F.sqrt(rr)
        return rows.groupBy("x", "y").agg(F.sum(c("mk") * dx / r).alias("ax"), F.sum(c("mk") * dy / r).alias("ay"))

    def around(level: int, reach: int) -> DataFrame:
        """Each body with the cells at most reach away."""
        moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
        own = at.select("x", "y", cell("x", low_x, level).alias("ox"), cell("y", low_y, level).alias("oy"), moves.alias("d"))
        return own.select("x", "y", "ox", "oy", (c("ox") + c("d.a")).alias("cx"), (c("oy") + c("d.b")).alias("cy"))

    singles = at.select(c("m").alias("mk"), c("x").alias("xk"), c("y").alias("yk"), cell("x", low_x, levels).alias("cx"), cell("y", low_y, levels).alias("cy"))
    most = singles.groupBy("cx", "cy").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    parts = max(1, -(-most // PAIRED))
    tasks = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = around(levels, 1).repartition(tasks, "x", "y").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    singles = singles.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    forces = pull(near.join(singles, ["cx", "cy", "part"]).filter("x != xk or y != yk"))
    for level in range(1, levels + 1):
        cells = at.groupBy(cell("x", low_x, level).alias("cx"), cell("y", low_y, level).alias("cy"))
        cells = cells.agg(F.sum("m").alias("mk"), (F.sum(c("m") * c("x")) / F.sum("m")).alias("xk"), (F.sum(c("m") * c("y")) / F.sum("m")).alias("yk"))
        half = lambda v: F.floor(c(v) / 2)
        apart = (F.abs(c("cx") - c("ox")) > 1) | (F.abs(c("cy") - c("oy")) > 1)
        akin = (F.abs(half("cx") - half("ox")) <= 1) & (F.abs(half("cy") - half("oy")) <= 1)
        forces = forces.unionByName(pull(around(level, 3).filter(apart & akin).join(cells, ["cx", "cy"])))
    total = forces.groupBy("x", "y").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))
    moved = bodies.join(total, ["x", "y"], "left").withColumns({"vx": c("vx") + dt * F.coalesce("ax", F.lit(0.0)), "vy": c("vy") + dt * F.coalesce("ay", F.lit(0.0))})
    return moved.select("i", "m", (c("x") + dt * c("vx")).alias("x"), (c("y") + dt * c("vy")).alias("y"), "vx", "vy")
