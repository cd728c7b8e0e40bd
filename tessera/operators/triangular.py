"""Triangular systems: chains of rows are folded by doubling, what is left is solved tile row by tile row.

A row is x_i = a_i + sum of w_ij x_j over rows before it. A round settles rows that need no other
(any level of them at once), folds rows that need one other into affine maps of the row where their
chain ends, in as many steps as the logarithm of its length, and puts both into the other rows,
where links that lead to the same row become one. Rounds go on while they leave few rows. The
others, if the weights of each row add up to less than 1, are found by sweeps over all rows, which
keep the matrix sparse; else they are numbered anew and solved by blocks. No round is made where
most rows need several others and sweeps will do.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.factor import triangular_blocks
from tessera.plans.matrix import Matrix
from tessera.plans.scan import ranked
from tessera.plans.storage import BROADCAST_ROWS, cut, shuffled
from tessera.plans.tiles import SIZE, Tiles
from tessera.plans.vector import Vector

c = F.col
#: A round that leaves a larger part of the rows is the last.
WORTH = 0.7
#: Rows whose weights add up to no more than this are left to sweeps.
CONTRACTION = 0.9
#: Sweeps that are one plan.
CHAINED = 4


def folded(single: DataFrame, many: int = 0) -> DataFrame:
    """single (i, p, a, w), x_i = a + w x_p, with every p that is an i itself replaced by the end of its chain; there are many rows at most."""
    while True:
        ahead = single.select(c("i").alias("p"), c("p").alias("q"), c("a").alias("b"), c("w").alias("u"))
        on = c("q").isNotNull()
        joined = single.join(shuffled(ahead, many), "p", "left").select(
            "i", F.coalesce("q", "p").alias("p"), F.when(on, c("a") + c("w") * c("b")).otherwise(c("a")).alias("a"), F.when(on, c("w") * c("u")).otherwise(c("w")).alias("w"), on.alias("moved")
        )
        single = cut(joined)
        if single.filter("moved").isEmpty():
            return single.drop("moved")
        single = single.drop("moved")


def _round(values: DataFrame, links: DataFrame, many: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From many rows (i, a) that aren't settled and links (i, j, w) among them: those settled now, the others, their links."""
    needs = links.groupBy("i").agg(F.count("*").alias("n"), F.first("j").alias("p"), F.first("w").alias("w"))
    rows = cut(shuffled(values, many).join(needs, "i", "left"))
    single = folded(cut(rows.filter("n = 1").select("i", "p", "a", "w")), many)
    free = rows.filter("n is null").select("i", "a")
    ends = shuffled(single, many).join(free.select(c("i").alias("p"), c("a").alias("x")), "p", "left")
    done = free.unionByName(ends.filter("x is not null").select("i", (c("a") + c("w") * c("x")).alias("a")))
    done = cut(done)
    open_ = cut(ends.filter("x is null").select("i", "p", "a", "w"))
    several = links.join(shuffled(rows.filter("n > 1").select("i"), many), "i", "left_semi")
    known = done.select(c("i").alias("j"), F.lit(None).cast("long").alias("p"), c("a").alias("b"), F.lit(0.0).alias("u"))
    known = known.unionByName(open_.select(c("i").alias("j"), "p", c("a").alias("b"), c("w").alias("u")))
    put = cut(several.join(shuffled(known, many), "j", "left").select("i", F.when(c("b").isNull(), c("j")).otherwise(c("p")).alias("j"), F.when(c("b").isNull(), c("w")).otherwise(c("w") * c("u")).alias("w"), F.coalesce(c("w") * c("b"), F.lit(0.0)).alias("add")))
    sums = put.groupBy("i").agg(F.sum("add").alias("add"))
    left = shuffled(rows.filter("n > 1"), many).join(sums, "i").select("i", (c("a") + c("add")).alias("a")).unionByName(open_.select("i", "a"))
    on = put.filter("j is not null").groupBy("i", "j").agg(F.sum("w").alias("w")).unionByName(open_.select("i", c("p").alias("j"), "w"))
    return done, cut(left), cut(on)


def _by_blocks(values: DataFrame, links: DataFrame, lower: bool, size: int) -> DataFrame:
    """The values (i, a) of rows that need one another in order, by tiles."""
    order = cut(ranked(values.select("i", c("a").alias("v")), c("i").asc()).select("i", "v", "rank"))
    n = order.count()
    at = lambda name: order.select(c("i").alias(name), c("rank").alias(f"r{name}"))
    off = links.join(at("i"), "i").join(at("j"), "j").select(c("ri").alias("i"), c("rj").alias("j"), (-c("w")).alias("v"))
    own = order.select(c("rank").alias("i"), c("rank").alias("j"), F.lit(1.0).alias("v"))
    system = Tiles.pack(Matrix(off.unionByName(own), n, n), size)
    found = triangular_blocks(Tiles(cut(system.df), n, n, size), Tiles.of_vector(Vector(order.select(c("rank").alias("i"), "v"), n), size), lower).vector()
    return found.df.select(c("i").alias("rank"), c("v").alias("a")).join(order.select("i", "rank"), "rank").select("i", "a")


def _by_sweeps(values: DataFrame, links: DataFrame, q: float, many: int) -> DataFrame:
    """The values (i, a) of rows whose weights add up to at most q < 1: a sweep makes the greatest error q times as large, and as many sweeps as there are rows leave none.

    CHAINED sweeps are one plan. Values of up to BROADCAST_ROWS rows are sent to the links, which are dealt by row,
    so that nothing is shuffled; more of them meet links that are dealt by what they join. Sweeps end where what
    is left to change is below the precision of the greatest value.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = many <= BROADCAST_ROWS
    by = "i" if sent else "j"
    dealt = links.repartition(tasks, by).sortWithinPartitions(by).persist(StorageLevel.MEMORY_AND_DISK)
    own = values.select("i", "a").repartition(tasks, "i").persist(StorageLevel.MEMORY_AND_DISK)
    state, shrunk = own.select("i", c("a").alias("x")), q**CHAINED
    for _ in range(math.ceil(min(many, math.log(1e-18) / math.log(q) + 1) / CHAINED)):
        x = state
        for _ in range(CHAINED):
            sums = dealt.join(x.select(c("i").alias("j"), "x").hint("broadcast" if sent else "merge"), "j").groupBy("i").agg(F.sum(c("w") * c("x")).alias("s"))
            x = own.join(sums.hint("merge"), "i", "left").select("i", (c("a") + F.coalesce("s", F.lit(0.0))).alias("x"))
        seen = Observation()
        before = state.select("i", c("x").alias("old")).hint("broadcast" if sent else "merge")
        state = cut(x.join(before, "i").observe(seen, F.max(F.abs(c("x") - c("old"))).alias("change"), F.max(F.abs("x")).alias("size")).select("i", "x"))
        if seen.get["change"] * shrunk <= (1 - shrunk) * 1e-16 * seen.get["size"]:
            break
    dealt.unpersist()
    own.unpersist()
    return state.select("i", c("x").alias("a"))


def triangular(matrix: Matrix, b: Vector, lower: bool = True, size: int = SIZE, worth: float = WORTH) -> tuple[Vector, int]:
    """(x, rounds) of a triangular system; entries on the other side of the diagonal are not read, and the diagonal must be there."""
    side = cut(matrix.df.filter("i >= j" if lower else "i <= j"))
    d = side.filter("i = j").select("i", c("v").alias("d"))
    values = cut(b.to_dense().df.join(shuffled(d, matrix.n), "i").select("i", (c("v") / c("d")).alias("a")))
    left = values.count()
    if left != matrix.n:
        raise ValueError("the diagonal has gaps")
    links = cut(side.filter("i != j").join(shuffled(d, matrix.n), "i").select("i", "j", (-c("v") / c("d")).alias("w")))
    parts, rounds = [], 0
    held = links.groupBy("i").agg(F.count("*").alias("n"), F.sum(F.abs("w")).alias("q")).agg(F.max("q").alias("q"), F.count_if(c("n") > 1).alias("several")).first()
    if held.q and held.q <= CONTRACTION and held.several > worth * left:  # a round would leave too many
        return Vector(cut(_by_sweeps(values, links, held.q, left).select("i", c("a").alias("v"))), matrix.n), rounds
    while left:
        done, values, links = _round(values, links, left)
        parts.append(done)
        rounds, before = rounds + 1, left
        left = values.count()
        if left > worth * before:
            q = links.groupBy("i").agg(F.sum(F.abs("w")).alias("q")).agg(F.max("q")).first()[0]
            parts.append(_by_sweeps(values, links, q, left) if 0 < q <= CONTRACTION else _by_blocks(values, links, lower, size))
            break
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return Vector(cut(whole.select("i", c("a").alias("v"))), matrix.n), rounds
