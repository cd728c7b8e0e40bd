"""Algebraic multigrid by smoothed aggregation.

Unknowns that are strongly linked are gathered around the members of a maximal independent set of
distance two, which rounds of random priorities find without any order of the unknowns. An
aggregate is an unknown of the next level; the step function of the aggregates, smoothed once by
Jacobi, is the prolongation P, and the next matrix is P^T A P.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.factor import lu
from tessera.operators.solvers import DEFAULT_STOP, Criterion, Solution, State, cg
from tessera.plans.matrix import Matrix
from tessera.plans.scan import ranked
from tessera.plans.sparse import Held
from tessera.plans.storage import BROADCAST_ROWS, cut, in_buckets, shuffled
from tessera.plans.vector import Vector

c = F.col
#: An entry is strong from this part of the geometric mean of both diagonal entries on.
STRONG = 0.08
#: Unknowns of the level that is solved by its factors.
COARSEST = 200
#: Unknowns, and entries, of the levels below the finest whose part of a cycle is one task: they are as many whatever the matrix.
GATHERED, GATHERED_ENTRIES = 1 << 15, 1 << 21
#: Factor of the Jacobi sweeps.
OMEGA = 2 / 3


def strong_links(a: Matrix, strong: float = STRONG) -> DataFrame:
    """(i, j) of the strong entries beside the diagonal, both ways."""
    d = a.df.filter("i = j").select("i", F.abs("v").alias("d"))
    rows = a.df.filter("i != j").join(d, "i").join(d.select(c("i").alias("j"), c("d").alias("e")), "j")
    some = rows.filter(F.abs("v") >= strong * F.sqrt(c("d") * c("e"))).select("i", "j")
    return some.unionByName(some.select(c("j").alias("i"), c("i").alias("j"))).distinct()


def independent_set(links: DataFrame, n: int) -> DataFrame:
    """(i) of a maximal set of which no two are within two links: in each round those that have the greatest priority within two links.

    What is out, and what was chosen before the last round, is no source of priorities: all within two links of it is decided.
    """
    spark = links.sparkSession
    around = links.unionByName(spark.range(n).select(c("id").alias("i"), c("id").alias("j")))
    around = cut(around) if n <= BROADCAST_ROWS else in_buckets(around, "j", int(spark.conf.get("spark.sql.shuffle.partitions")))
    state = cut(spark.range(n).select(c("id").alias("i"), F.lit(1).alias("s")))  # 3: chosen before, 2: chosen in the last round, 1: open, 0: out
    while True:
        own = F.struct("s", F.xxhash64("i").alias("h"), c("i").alias("k"))
        sources = state.filter("s IN (1, 2)").select(c("i").alias("j"), own.alias("t"))
        first = around.join(shuffled(sources, n), "j").groupBy("i").agg(F.max("t").alias("t"))
        second = around.join(shuffled(first.withColumnRenamed("i", "j"), n), "j").groupBy("i").agg(F.max("t").alias("t"))
        now = F.when(c("s") == 2, 3).when(c("s") != 1, c("s")).when(c("t.k") == c("i"), 2).when(c("t.s") == 2, 0).otherwise(1)
        state = cut(shuffled(state, n).join(second, "i", "left").select("i", now.alias("s")))
        if state.filter("s = 1").isEmpty():
            return state.filter("s >= 2").select("i")


def aggregates(links: DataFrame, n: int) -> tuple[DataFrame, int]:
    """((i, k), number): every index in one aggregate: those of the set, their neighbours, and what is next to these."""
    roots = cut(ranked(independent_set(links, n).withColumn("v", F.lit(0.0)), c("i").asc()).select("i", c("rank").alias("k")))
    near = links.join(shuffled(roots.withColumnRenamed("i", "j"), n), "j").groupBy("i").agg(F.min("k").alias("k")).join(shuffled(roots.select("i"), n), "i", "left_anti")
    first = cut(roots.unionByName(near))
    rest = links.join(shuffled(first.select("i"), n), "i", "left_anti").join(shuffled(first.withColumnRenamed("i", "j"), n), "j")
    rest = rest.groupBy("i", "k").agg(F.count("*").alias("n")).groupBy("i").agg(F.max_by("k", F.struct("n", "k")).alias("k"))
    return cut(first.unionByName(rest)), roots.count()


def prolongation(a: Matrix, groups: DataFrame, k: int, links: DataFrame) -> Matrix:
    """(I - w D^-1 A) times the step functions of the aggregates, A with the strong links (i, j) alone, its other entries being added to the diagonal; w is 4/3 of the inverse of a bound on the spectrum."""
    kept = a.df.join(shuffled(links.withColumn("on", F.lit(True)), a.n), ["i", "j"], "left").select("i", F.when(c("on").isNull(), c("i")).otherwise(c("j")).alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))
    kept = cut(kept)
    d = kept.filter("i = j").select("i", c("v").alias("d"))
    scaled = cut(kept.join(shuffled(d, a.n), "i").select("i", "j", (c("v") / c("d")).alias("v")))
    bound = scaled.groupBy("i").agg(F.sum(F.abs("v")).alias("v")).agg(F.max("v")).first()[0]
    step = Matrix(groups.select("i", c("k").alias("j"), F.lit(1.0).alias("v")), a.n, k)
    return Matrix(cut(step.plus(Matrix(scaled, a.n, a.n).matmul(step, hot=None), 1.0, -4 / 3 / bound).df), a.n, k)


@dataclass(frozen=True)
class Level:
    """A level's matrix and, but for the last one, what a cycle needs of it: [S Q] and the transpose of Q.

    With D the diagonal of A, Q = (1 - w D^-1 A) P and S = 2 w D^-1 - w^2 D^-1 A D^-1, a sweep from 0,
    the residual's way down, the correction by e and a sweep are S b + Q e, where e is that of the next level for Q^T b.
    """

    a: Matrix
    cycle: Held | None = None
    down: Held | None = None


@dataclass(frozen=True)
class Hierarchy:
    """Levels from the finest on, all of them written tables, and the inverse of the last one's matrix.

    The part of a cycle from the level gathered on, if there is one, is that of a task; small has its levels.
    """

    levels: list[Level]
    last: Matrix
    gathered: int | None = None
    small: Broadcast | None = field(default=None, repr=False)

    @property
    def sizes(self) -> list[int]:
        return [level.a.n for level in self.levels]

    def release(self) -> None:
        """Lets go what executors keep for the products; cycles make it again."""
        for level in self.levels:
            for m in (level.cycle, level.down):
                if m is not None:
                    m.release()

    def cycle(self, b: Vector) -> Vector:
        """A V-cycle from 0 with a Jacobi sweep down and one up: two products a level."""
        return Vector(cut(self._cycle(b.df, 0)), b.n)

    def _cycle(self, b: DataFrame, at: int) -> DataFrame:
        """(i, v) of a cycle for b (i, v), in which, as in b, what is not there is 0."""
        level = self.levels[at]
        if at == self.gathered:
            small = self.small
            return b.select("i", "v").repartition(1).mapInArrow(lambda batches: _of_one_task(batches, small.value), "i long, v double")
        if level.cycle is None:
            return self.last.times(Vector(b, level.a.n)).df
        e = cut(self._cycle(cut(level.down.sums(b)) if at + 1 != self.gathered else level.down.sums(b), at + 1))
        return level.cycle.sums(b.select("i", "v").unionByName(e.select((c("i") + level.a.n).alias("i"), "v")))


def _of_one_task(batches, small: tuple[list, np.ndarray]):
    """A cycle over small levels, given as (unknowns, i, j, v) of [S Q], and the inverse of the last one's matrix."""
    levels, last = small
    rows = pa.Table.from_batches(list(batches))
    b = np.zeros(levels[0][0] if levels else len(last))
    np.add.at(b, rows["i"].to_numpy(), rows["v"].to_numpy())

    def cycle(b: np.ndarray, at: int) -> np.ndarray:
        if at == len(levels):
            return last @ b
        n, i, j, v = levels[at]
        below = j >= n
        size = levels[at + 1][0] if at + 1 < len(levels) else len(last)
        e = cycle(np.bincount(j[below] - n, v[below] * b[i[below]], size), at + 1)
        return np.bincount(i, v * np.concatenate((b, e))[j], n)

    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(b))), pa.array(cycle(b, 0))], names=["i", "v"])


def _smoothed(a: Matrix, d: DataFrame, p: Matrix, half: Matrix, omega: float) -> tuple[DataFrame, DataFrame]:
    """(i, j, v) of S and of Q of a level, half being A P."""
    e = d.select(c("i").alias("j"), c("d").alias("e"))
    rows = a.df.join(shuffled(d, a.n), "i").join(shuffled(e, a.n), "j")
    s = rows.select("i", "j", (F.when(c("i") == c("j"), 2 * omega / c("d")).otherwise(0.0) - omega * omega * c("v") / (c("d") * c("e"))).alias("v"))
    rows = half.df.join(shuffled(d, a.n), "i").select("i", "j", (-omega * c("v") / c("d")).alias("v"))
    return s, rows.unionByName(p.df.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def _with_small(levels: list[Level], last: Matrix, gathered: int) -> Hierarchy:
    """The hierarchy, with levels below the finest of so many unknowns at most, and of bounded entries, for one task."""
    first = next((at for at, level in enumerate(levels) if at > 0 and level.a.n <= gathered), None)
    held = sum(level.cycle.df.count() for level in levels[first:-1]) + last.n * last.n if first is not None else 0
    if first is None or held > GATHERED_ENTRIES:
        return Hierarchy(levels, last)
    arrays = [(level.a.n, *(x.to_numpy() for x in level.cycle.df.toArrow().select(["i", "j", "v"]).columns)) for level in levels[first:-1]]
    inverse, (i, j, v) = np.zeros((last.n, last.n)), (x.to_numpy() for x in last.df.toArrow().select(["i", "j", "v"]).columns)
    inverse[i, j] = v
    return Hierarchy(levels, last, first, last.df.sparkSession.sparkContext.broadcast((arrays, inverse)))


def hierarchy(matrix: Matrix, coarsest: int = COARSEST, most: int = 10, strong: float = STRONG, omega: float = OMEGA, gathered: int = GATHERED) -> Hierarchy:
    """The levels of a symmetric positive definite matrix with a full diagonal."""
    levels, a = [], Matrix(cut(matrix.df), matrix.n, matrix.n)
    while not (a.n <= coarsest or len(levels) == most - 1):
        links = cut(strong_links(a, strong))
        groups, k = aggregates(links, a.n)
        if k > 0.8 * a.n:
            break
        p = prolongation(a, groups, k, links)
        half = Matrix(cut(a.matmul(p, hot=None).df), a.n, k)
        s, q = _smoothed(a, a.df.filter("i = j").select("i", c("v").alias("d")), p, half, omega)
        q = cut(q)
        both = cut(s.unionByName(q.select("i", (c("j") + a.n).alias("j"), "v")))
        levels.append(Level(a, Held(both, a.n, a.n + k), Held(q.select(c("j").alias("i"), c("i").alias("j"), "v"), k, a.n)))
        a = Matrix(cut(p.transpose().matmul(half, hot=None).df), k, k)
    levels.append(Level(a))
    last = Matrix(cut(lu(a).inverse().entries().df), a.n, a.n)
    return _with_small(levels, last, gathered)


def multigrid(h: Hierarchy) -> Callable[[State, str, Column], State]:
    """A V-cycle as a preconditioner."""

    def apply(s: State, to: str, of: Column) -> State:
        return s.join(h._cycle(s.df.select("i", of.alias("v")), 0).select("i", c("v").alias("__sum")), to)

    apply.joins = True
    return apply


def amg(matrix: Matrix, b: Vector, x0: Vector | None = None, stop: Criterion = DEFAULT_STOP, coarsest: int = COARSEST, strong: float = STRONG, alone: bool = False) -> Solution:
    """Conjugate gradients with a V-cycle a step; alone, V-cycles on the residual."""
    h = hierarchy(matrix, coarsest, strong=strong)
    a = Held(h.levels[0].a.df, matrix.n, matrix.n)
    try:
        return _solved(a, b, x0, stop, h, alone)
    finally:
        a.release()
        h.release()


def _solved(a: Held, b: Vector, x0: Vector | None, stop: Criterion, h: Hierarchy, alone: bool) -> Solution:
    if not alone:
        return cg(a, b, x0, stop, preconditioner=multigrid(h))
    x = x0 or Vector.fill(a.df.sparkSession, a.n, 0.0)
    r = Vector(cut(a.times(x, -1.0, b.to_dense(), 1.0).df), b.n)
    norms = [r.l2_norm().first()[0]]
    while not stop(norms):
        e = h.cycle(r)
        x = Vector(cut(x.plus(e).df), b.n)
        r = Vector(cut(a.times(e, -1.0, r, 1.0).df), b.n)
        norms.append(r.l2_norm().first()[0])
    return Solution(x, norms)
