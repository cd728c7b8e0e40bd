"""Factors of dense or filled-in systems over tiles, kept for any number of right sides.

LU goes panel by panel, a panel being a column of tiles. Its pivot rows are found by a tournament:
each tile names the rows that its own elimination picks, then groups of such candidates play until
one group is left, so that no task has a whole panel. Pivot rows aren't moved: they leave the
matrix, and the lower factor is put into pivot order once, at the end. LDL^T, for symmetric matrices
whose diagonal blocks are regular in order, works on the tiles of the lower triangle alone.

Unknowns of a large matrix that need one another (its connected components) are numbered one after
another, in bins that start at a tile each. Nothing links two bins, so a step takes a panel of every
bin, and there are as many steps as one bin has panels. Tiles between bins are never made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.scan import prefix_sum
from tessera.plans.storage import cut, dropped, shuffled
from tessera.plans.tiles import SIZE, TYPES, Tiles, block_of, handed_on, products, summed, tile_batch
from tessera.plans.vector import Vector

#: Candidates of so many tiles of SIZE rows play in one task.
PLAY = 16
#: Rows of the largest tiles of factors: 8 MB of doubles.
LARGEST = 1024
#: Unknowns from which on components are looked for, and the rounds after which a matrix counts as one.
BINNED, ROUNDS = 4096, 12
#: Bins up to which their diagonal blocks are sent to all tiles; more of them are shuffled.
SENT = 8
#: Tasks that a product of panels is dealt to at least.
DEALT = 16

_CANDIDATES = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("rows", pa.list_(pa.int64())), ("block", pa.binary())])
_CANDIDATE_TYPES = "b long, g long, rows array<long>, block binary"


def eliminated(a: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(order, lu): the rows by elimination with partial pivoting, and both factors in one array; columns to the right follow after each width of them."""
    lu, order = a.copy(), np.arange(len(a))
    for first in range(0, min(a.shape), width):
        last = min(first + width, *a.shape)
        for k in range(first, last):
            p = k + int(np.argmax(np.abs(lu[k:, k])))
            if lu[p, k] == 0:
                continue
            if p != k:
                lu[[k, p]], order[[k, p]] = lu[[p, k]], order[[p, k]]
            lu[k + 1 :, k] /= lu[k, k]
            lu[k + 1 :, k + 1 : last] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 : last])
        if last < a.shape[1]:
            lu[first:last, last:] = np.linalg.solve(np.tril(lu[first:last, first:last], -1) + np.eye(last - first), lu[first:last, last:])
            lu[last:, last:] -= lu[last:, first:last] @ lu[first:last, last:]
    return order, lu


def _best(rows: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that elimination picks, as many as there are columns, in that order, as they were."""
    order = eliminated(block)[0][: block.shape[1]]
    return rows[order], block[order]


def _candidates(b: int, g: int, rows: np.ndarray, block: np.ndarray) -> list[pa.Array]:
    return [pa.array([b], pa.int64()), pa.array([g], pa.int64()), pa.array([rows.tolist()], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(block).tobytes()], pa.binary())]


def _entrants(shape, size: int, period: int, play: int):
    """What each tile of a panel sends to the tournament of its bin."""

    def run(batches):
        for b in batches:
            for bi, bj, raw in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("block")):
                found, block = _best(np.arange(shape(bi, bj)[0]) + bi * size, block_of(raw.as_py(), shape(bi, bj)[0]))
                yield pa.RecordBatch.from_arrays(_candidates(bi // period, bi % period // play, found, block), schema=_CANDIDATES)

    return run


def _played(play: int):
    def run(table: pa.Table) -> pa.Table:
        """The best rows of a group of candidates."""
        order = np.argsort([r[0] for r in table.column("rows").to_pylist()])
        rows = [np.array(table.column("rows")[k].as_py()) for k in order.tolist()]
        blocks = [block_of(table.column("block")[k].as_py(), len(r)) for k, r in zip(order.tolist(), rows)]
        found, block = _best(np.concatenate(rows), np.concatenate(blocks))
        return pa.Table.from_arrays(_candidates(table.column("b")[0].as_py(), table.column("g")[0].as_py() // play, found, block), schema=_CANDIDATES)

    return run


_PIVOTS = pa.schema([("b", pa.int64()), ("rows", pa.list_(pa.int64())), ("lu", pa.binary()), ("regular", pa.bool_())])


def _pivots(panel: Tiles, period: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """((b, lu), {b: rows}): the factors of the block of pivot rows of each bin's panel, a written table, and the numbers of these rows, all that reaches the driver."""
    play = min(PLAY, max(2, PLAY * SIZE // panel.size))
    found, groups = panel.df.mapInArrow(_entrants(panel.shape(), panel.size, period, play), _CANDIDATE_TYPES), -(-period // play)
    while True:
        found = found.groupBy("b", "g").applyInArrow(_played(play), _CANDIDATE_TYPES)
        if groups == 1:
            break
        groups = -(-groups // play)

    def factors(batches):
        for batch in batches:
            for b, rows, raw in zip(batch.column("b").to_pylist(), batch.column("rows").to_pylist(), batch.column("block")):
                order, lu = eliminated(block_of(raw.as_py(), len(rows)))
                regular = len(lu) == lu.shape[1] and bool((np.diag(lu) != 0).all())
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.array(rows)[order].tolist()], pa.list_(pa.int64())), pa.array([lu.tobytes()], pa.binary()), pa.array([regular])], schema=_PIVOTS)

    last = cut(found.mapInArrow(factors, "b long, rows array<long>, lu binary, regular boolean"))
    rows = last.select("b", "rows", "regular").collect()
    if len(rows) < -(-panel.down // period) or not all(r.regular for r in rows):
        raise ValueError("the matrix is singular")
    return last.select("b", "lu"), {r.b: r.rows for r in rows}


def _with_blocks(tiles: DataFrame, blocks: DataFrame, bins: int, period: int) -> DataFrame:
    """The tiles (bi, bj, block), each with its bin's row of blocks (b, ...)."""
    return tiles.withColumn("b", F.expr(f"bi div {period}")).join(F.broadcast(blocks) if bins <= SENT else shuffled(blocks, 1 << 62), "b")


def _solved(rows: DataFrame, f) -> DataFrame:
    """The tiles f(bi, bj, block, other) of rows (bi, bj, block, x), a block and the bytes of another one."""

    def made(batches):
        for b in batches:
            for r in range(b.num_rows):
                bi, bj = b.column("bi")[r].as_py(), b.column("bj")[r].as_py()
                yield bi, bj, f(bi, bj, b.column("block")[r].as_py(), b.column("x")[r].as_py())

    return rows.select("bi", "bj", "block", "x").mapInArrow(lambda batches: handed_on(made(batches)), TYPES)


def crossed(left: DataFrame, right: DataFrame, bins: int, period: int, wide: int | None = None) -> DataFrame:
    """(bi, k, bj, x, y): each (bi, k, x) with each (k, bj, y) of the same inner tile k; an inner tile's pairs are made by several tasks, unless there are many bins.

    right has as many columns of tiles as wide, or many.
    """
    p = 1
    while bins * p * p < DEALT:
        p += 1
    q = min(p, wide or p)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("k", "bi", "x", (F.col("bi") % p).cast("int").alias("ri"), every(q).alias("rj"))
    right = right.select("k", "bj", "y", (F.col("bj") % q).cast("int").alias("rj"), every(p).alias("ri"))
    return left.join(right.hint("merge"), ["k", "ri", "rj"])


def _pivot_tiles(a: Tiles, k: int, period: int, pivots: dict[int, list[int]], lu: DataFrame) -> DataFrame:
    """The row of tiles of the upper factor of each bin: the pivot rows right of panel k, in order, divided by the lower block."""
    shape, size, place = a.shape(), a.size, {int(r): p for rows in pivots.values() for p, r in enumerate(rows)}
    blocks = sorted({r // size for r in place})
    schema = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("places", pa.list_(pa.int32())), ("block", pa.binary())])

    def pick(batches):
        for b in batches:
            for bi, bj, raw in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("block")):
                rows = shape(bi, bj)[0]
                mine = [(place[r + bi * size], r) for r in range(rows) if r + bi * size in place]
                if mine:
                    block = block_of(raw.as_py(), rows)[[r for _, r in mine]].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([bi // period * period + k], pa.int64()), pa.array([bj], pa.int64()), pa.array([[p for p, _ in mine]], pa.list_(pa.int32())), pa.array([block], pa.binary())], schema=schema)

    def put(table: pa.Table) -> pa.Table:
        places, bi, bj = table.column("places").to_pylist(), table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        whole = np.zeros(shape(bi, bj))
        for p, raw in zip(places, table.column("block")):
            whole[p] = block_of(raw.as_py(), len(p))
        return pa.Table.from_batches([tile_batch([(bi, bj, whole)])])

    def divided(bi, bj, raw, other):
        n = shape(bi, bi)[0]
        return np.linalg.solve(np.tril(block_of(other, n), -1) + np.eye(n), block_of(raw, n))

    picked = a.df.filter((F.col("bj") % period > k) & F.col("bi").isin(blocks)).mapInArrow(pick, "bi long, bj long, places array<int>, block binary")
    rows = picked.groupBy("bi", "bj").applyInArrow(put, TYPES)
    return _solved(_with_blocks(rows, lu.withColumnRenamed("lu", "x"), len(pivots), period), divided)


def _in_order(lower: Tiles, order: DataFrame) -> Tiles:
    """The tiles with their rows in the order (row, p)."""
    shape, size = lower.shape(), lower.size
    schema = pa.schema([("row", pa.int64()), ("bj", pa.int64()), ("v", pa.binary())])

    def rows(batches):
        for b in batches:
            for bi, bj, raw in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("block")):
                block = block_of(raw.as_py(), shape(bi, bj)[0])
                some = np.flatnonzero(block.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(some + bi * size), pa.array(np.full(len(some), bj)), pa.array([block[r].tobytes() for r in some], pa.binary())], schema=schema)

    def put(batches):
        for b in batches:
            for bi, bj, e in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("e")):
                block = np.zeros(shape(bi, bj))
                block[e.values.field("r").to_numpy()] = np.frombuffer(b"".join(x.as_py() for x in e.values.field("v")), np.float64).reshape(len(e), -1)
                yield bi, bj, block

    dealt = lower.df.mapInArrow(rows, "row long, bj long, v binary").join(order, "row")
    packed = dealt.groupBy(F.floor(F.col("p") / size).cast("long").alias("bi"), "bj").agg(F.collect_list(F.struct((F.col("p") % size).cast("int").alias("r"), "v")).alias("e"))
    return Tiles(packed.mapInArrow(lambda batches: handed_on(put(batches)), TYPES), lower.n, lower.m, size)


def triangular_blocks(t: Tiles, b: Tiles, lower: bool = True, period: int | None = None) -> Tiles:
    """X with T X = B for a block triangular T: a step solves for a row of tiles (of each bin of period rows) and takes its multiples from those that follow."""
    size, its, mine, period = b.size, b.shape(), t.shape(), period or t.down
    bins = -(-t.down // period)
    steps = range(period) if lower else range(period - 1, -1, -1)
    rest, found = Tiles(cut(b.df), b.n, b.m, size), []

    def solve(bi, bj, raw, other):
        n = its(bi, bj)[0]
        return np.linalg.solve(block_of(other, n), block_of(raw, n))

    row = F.col("bi") % period
    for k in steps:
        diagonal = t.df.filter((row == k) & (F.col("bi") == F.col("bj"))).select(F.expr(f"bi div {period}").alias("b"), F.col("block").alias("x"))
        x = cut(_solved(_with_blocks(rest.df.filter(row == k), diagonal, bins, period), solve))
        found.append(x)
        after = (row > k) if lower else (row < k)
        if k == steps[-1]:
            break
        column = t.df.filter((F.col("bj") % period == k) & after).select("bi", F.col("bj").alias("k"), F.col("block").alias("x"))
        parts = products(crossed(column, x.select(F.col("bi").alias("k"), "bj", F.col("block").alias("y")), bins, period, b.across), mine, its, -1.0)
        before, rest = rest, Tiles(cut(summed(rest.df.filter(after).unionByName(parts), its)), b.n, b.m, size)
        dropped(before.df)
    dropped(rest.df)
    return Tiles(_union(found), b.n, b.m, size)


@dataclass(frozen=True)
class Factors:
    """Written tables: a lower and an upper block triangular matrix, whose product has the rows of the system in the order (row, p).

    With place (i, p) the system's unknown i has the number p there; period is the number of rows of tiles of a bin.
    """

    lower: Tiles
    upper: Tiles
    order: DataFrame | None = None
    place: DataFrame | None = None
    period: int | None = None
    n: int = 0

    def solve(self, b: Vector) -> Vector:
        """The solution for a right side."""
        rows = b.to_dense().df
        if self.place is not None:
            rows = rows.join(shuffled(self.place, self.n), "i").select(F.col("p").alias("i"), "v")
        if self.order is not None:
            rows = rows.join(shuffled(self.order.select(F.col("row").alias("i"), "p"), self.n), "i").select(F.col("p").alias("i"), "v")
        x = self.solve_tiles(Tiles.of_vector(Vector(rows, self.lower.n), self.lower.size)).vector()
        if self.place is None:
            return x
        return Vector(x.df.withColumnRenamed("i", "p").join(shuffled(self.place, self.n), "p").select("i", "v"), self.n)

    def solve_tiles(self, b: Tiles) -> Tiles:
        """Solutions for the columns of tiles whose rows are in pivot order."""
        return triangular_blocks(self.upper, triangular_blocks(self.lower, b, True, self.period), False, self.period)

    def inverse(self) -> Tiles:
        """The inverse of the system, as tiles; those that are 0 may be left out."""
        spark, n = self.lower.df.sparkSession, self.lower.n
        rows = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j")) if self.order is None else self.order.select(F.col("p").alias("i"), F.col("row").alias("j"))
        whole = self.place is None
        found = self.solve_tiles(Tiles.pack(Matrix(rows.withColumn("v", F.lit(1.0)), n, n), self.lower.size, full=whole))
        if whole:
            return found
        at = lambda name, p: shuffled(self.place.select(F.col("i").alias(name), F.col("p").alias(p)), self.n)
        entries = found.entries().df.select(F.col("i").alias("pi"), F.col("j").alias("pj"), "v").join(at("i", "pi"), "pi").join(at("j", "pj"), "pj").select("i", "j", "v")
        return Tiles.pack(Matrix(entries, self.n, self.n), SIZE)


def components(matrix: Matrix, rounds: int = ROUNDS) -> DataFrame | None:
    """(i, c), the least number of what is linked with i in either direction; None if rounds don't suffice to tell."""
    spark, n = matrix.df.sparkSession, matrix.n
    links = matrix.df.filter("i != j").select("i", "j")
    links = cut(links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    found = cut(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("c")))
    for _ in range(rounds):
        near = links.join(shuffled(found.select(F.col("i").alias("j"), "c"), n), "j").groupBy("i").agg(F.min("c").alias("m"))
        least = cut(shuffled(found, n).join(near, "i", "left").select("i", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        if least.filter("moved").isEmpty():
            return least.select("i", "c")
        ends = least.select(F.col("i").alias("c"), F.col("c").alias("e"))
        found = cut(shuffled(least.select("i", "c"), n).join(shuffled(ends, n), "c").select("i", F.col("e").alias("c")))
    return None


def binned(matrix: Matrix, size: int | None = None) -> tuple[DataFrame, int, int, int] | None:
    """((i, p), bins, rows of tiles of a bin, size): whole components, one after another, in bins as large as the largest; None if that has half of all unknowns."""
    found = components(matrix)
    if found is None:
        return None
    sizes = cut(found.groupBy("c").agg(F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0]
    if 2 * most > matrix.n:
        return None
    size = size or min(LARGEST, max(SIZE, -(-most // 64) * 64))
    counted = lambda some, v: prefix_sum(some.select(F.col("c").alias("i"), v.cast("double").alias("v")), True).select(F.col("i").alias("c"), F.col("v").cast("long").alias("at"))
    large, small, half = sizes.filter(F.col("n") * 2 > most), sizes.filter(F.col("n") * 2 <= most), max(1, most // 2)
    many = large.count()
    bins = cut(counted(large, F.lit(1)).select("c", F.col("at").alias("bin")).unionByName(counted(small, F.col("n")).select("c", (F.expr(f"at div {half}") + many).alias("bin"))))
    rows = found.join(shuffled(bins, matrix.n), "c")
    # of several components, those that start in the same half of the largest one's size share a bin
    ranked = Window.partitionBy("bin").orderBy("c", "i")
    period = -(-most // size)
    place = cut(rows.select("i", (F.col("bin") * (period * size) + F.row_number().over(ranked) - 1).alias("p")))
    return place, bins.agg(F.max("bin")).first()[0] + 1, period, size


def _laid_out(matrix: "Matrix | Tiles", size: int | None, full: bool, lower: bool = False) -> tuple[Tiles, int, DataFrame | None, int]:
    """(tiles, rows of tiles of a bin, place, unknowns) of a system; unknowns that fill up a bin have a 1 on the diagonal."""
    if matrix.n != matrix.m:
        raise ValueError(f"{matrix.n} x {matrix.m} is not square")
    if isinstance(matrix, Tiles):
        return matrix, matrix.down, None, matrix.n
    n, found = matrix.n, binned(matrix, size) if matrix.n >= BINNED else None
    place = None
    if found is not None:
        place, bins, period, size = found
        at = lambda name: shuffled(place.select(F.col("i").alias(name), F.col("p").alias(f"p{name}")), n)
        rows = matrix.df.join(at("i"), "i").join(at("j"), "j").select(F.col("pi").alias("i"), F.col("pj").alias("j"), "v")
        whole = bins * period * size
        free = matrix.df.sparkSession.range(whole).join(shuffled(place.select(F.col("p").alias("id")), n), "id", "left_anti")
        matrix = Matrix(rows.unionByName(free.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))), whole, whole)
    else:
        size = size or (LARGEST if n <= LARGEST else min(LARGEST, max(SIZE, -(-n // 512) * 64)))
        period = -(-n // size)
    if lower:
        matrix = Matrix(matrix.df.filter(F.col("i") >= F.col("j") - F.col("j") % size), matrix.n, matrix.m)
    return Tiles.pack(matrix, size, full=full and place is None), period, place, n


def lu(matrix: "Matrix | Tiles", size: int | None = None) -> Factors:
    """P A = L U with pivoting by rows, a panel of size columns (of each bin) a step; a singular matrix is an error."""
    a, period, place, n = _laid_out(matrix, size, full=True)
    spark, size, bins, shape = a.df.sparkSession, a.size, -(-a.down // period), a.shape()
    rest = Tiles(cut(a.df), a.n, a.m, size)
    lowers, uppers, orders = [], [], []
    for k in range(period):
        panel = rest.where(F.col("bj") % period == k)
        both, pivots = _pivots(panel, period)
        at: dict[int, list[tuple[int, int]]] = {}
        for rows in pivots.values():
            for p, r in enumerate(rows):
                at.setdefault(r // size, []).append((r % size, p))

        def multiples(bi, bj, raw, other, at=at):
            n = shape(bj, bj)[0]
            made = np.linalg.solve(np.triu(block_of(other, n)).T, block_of(raw, shape(bi, bj)[0]).T).T
            made[[r for r, _ in at.get(bi, [])]] = 0
            return made

        def with_pivots(bi, bj, raw, other, at=at):
            n = shape(bj, bj)[0]
            made, lower = block_of(raw, shape(bi, bj)[0]).copy(), np.tril(block_of(other, n), -1) + np.eye(n)
            for r, p in at.get(bi, []):
                made[r] = lower[p]
            return made

        def without_pivots(bi, bj, block, at=at):
            made = block.copy()
            made[[r for r, _ in at.get(bi, [])]] = 0
            return made

        blocks = both.withColumnRenamed("lu", "x")
        left = cut(_solved(_with_blocks(panel.df, blocks, bins, period), multiples))
        lowers.append(_solved(_with_blocks(left, blocks, bins, period), with_pivots))
        corner = both.select((F.col("b") * period + k).alias("bi"), (F.col("b") * period + k).alias("bj"), F.col("lu").alias("block"))
        uppers.append(Tiles(corner, a.n, a.m, size).each(lambda bi, bj, block: np.triu(block)).df)
        orders.append(spark.createDataFrame([(int(r), (b * period + k) * size + p) for b, rows in pivots.items() for p, r in enumerate(rows)], "row long, p long"))
        if k == period - 1:
            break
        top = cut(_pivot_tiles(rest, k, period, pivots, both))
        uppers.append(top)
        pairs = crossed(left.select("bi", F.col("bj").alias("k"), F.col("block").alias("x")), top.select(F.col("bi").alias("k"), "bj", F.col("block").alias("y")), bins, period)
        others = rest.where(F.col("bj") % period > k).each(without_pivots).df
        before, rest = rest, Tiles(cut(summed(others.unionByName(products(pairs, shape, shape, -1.0)), shape)), a.n, a.m, size)
        dropped(before.df)
    order = cut(_union(orders))
    whole = lambda parts: Tiles(_union(parts), a.n, a.m, size)
    lower, upper = _written(_in_order(whole(lowers), order)), _written(whole(uppers))
    dropped(rest.df)
    return Factors(lower, upper, order, place, period, n)


def ldlt(matrix: "Matrix | Tiles", size: int | None = None) -> Factors:
    """A = L D L^T of a symmetric matrix, of which the lower triangle is read; upper is D L^T. A singular diagonal block is an error: take lu()."""
    a, period, place, n = _laid_out(matrix, size, full=True, lower=True)
    size, bins, shape = a.size, -(-a.down // period), a.shape()
    rest = Tiles(cut(a.where("bi >= bj").df), a.n, a.m, size)
    lowers, uppers = [], []

    def symmetric(block: np.ndarray) -> np.ndarray:
        return np.tril(block) + np.tril(block, -1).T

    def condition(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.cond(symmetric(block_of(raw.as_py(), shape(bi, bi)[0])))) for bi, raw in zip(b.column("bi").to_pylist(), b.column("block"))], pa.float64())], names=["v"])

    for k in range(period):
        own = (F.col("bi") == F.col("bj")) & (F.col("bj") % period == k)
        diagonal = Tiles(cut(rest.where(own).each(lambda bi, bj, block: symmetric(block)).df), a.n, a.m, size)
        conditions = [r.v for r in diagonal.df.mapInArrow(condition, "v double").collect()]
        if len(conditions) < bins or not all(v <= 1e14 for v in conditions):
            raise ValueError("a diagonal block is singular")
        lowers.append(diagonal.each(lambda bi, bj, block: np.eye(len(block))).df)
        uppers.append(diagonal.df)
        if k == period - 1:
            break
        panel = rest.where((F.col("bj") % period == k) & (F.col("bi") > F.col("bj")))
        blocks = diagonal.df.select(F.expr(f"bi div {period}").alias("b"), F.col("block").alias("x"))
        left = cut(_solved(_with_blocks(panel.df, blocks, bins, period), lambda bi, bj, raw, other: np.linalg.solve(block_of(other, shape(bj, bj)[0]), block_of(raw, shape(bi, bj)[0]).T).T))
        top = cut(panel.transpose().df)
        lowers.append(left)
        uppers.append(top)
        pairs = crossed(left.select("bi", F.col("bj").alias("k"), F.col("block").alias("x")), top.select(F.col("bi").alias("k"), "bj", F.col("block").alias("y")), bins, period).filter("bi >= bj")
        others = rest.df.filter(F.col("bj") % period > k)
        before, rest = rest, Tiles(cut(summed(others.unionByName(products(pairs, shape, shape, -1.0)), shape)), a.n, a.m, size)
        dropped(before.df)
    dropped(rest.df)
    whole = lambda parts: Tiles(_union(parts), a.n, a.m, size)
    return Factors(whole(lowers), whole(uppers), None, place, period, n)


def factorize(matrix: "Matrix | Tiles", symmetric: bool = False, size: int | None = None) -> Factors:
    return ldlt(matrix, size) if symmetric else lu(matrix, size)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _written(t: Tiles) -> Tiles:
    return Tiles(cut(t.df), t.n, t.m, t.size)
