"""Dense matrices as tables of square tiles (bi, bj, block), each block a binary of row-major doubles.

A product joins the tiles of one inner block, multiplies pairs with numpy, and adds up products of
the same place within each task before they are shuffled. Tiles at the lower and right edge are as
small as the matrix ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector

SIZE = 256
#: Bytes of sums that a task of a product holds before it hands them on.
HELD = 64 << 20
#: Bytes of tiles that a task hands on at once; a batch of narrow rows can make many times as many.
HANDED = 16 << 20
TYPES = "bi long, bj long, block binary"

_SCHEMA = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("block", pa.binary())])


def tile_batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    bi, bj, blocks = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bi, pa.int64()), pa.array(bj, pa.int64()), pa.array([np.ascontiguousarray(b).tobytes() for b in blocks], pa.binary())], schema=_SCHEMA)


def handed_on(rows: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of at most HANDED bytes (or one tile) of tiles as they are made."""
    held, size = [], 0
    for row in rows:
        if held and size + row[2].nbytes > HANDED:
            yield tile_batch(held)
            held, size = [], 0
        held.append(row)
        size += row[2].nbytes
    if held:
        yield tile_batch(held)


def block_of(raw: bytes, rows: int) -> np.ndarray:
    """A block of so many rows, which must not be written to."""
    return np.frombuffer(raw, np.float64).reshape(rows, -1)


@dataclass(frozen=True)
class Tiles:
    """df (bi, bj, block) of an n x m matrix; tiles that are missing are 0."""

    df: DataFrame
    n: int
    m: int
    size: int = SIZE

    # -- making

    @classmethod
    def pack(cls, matrix: Matrix, size: int = SIZE, full: bool = False) -> "Tiles":
        """The tiles of a table of triples; with full those without entries, too. A tile's entries are one group of size x size at most."""
        n, m = matrix.n, matrix.m
        i, j = F.col("i"), F.col("j")
        width = F.least(F.lit(size).cast("long"), F.lit(m) - F.floor(j / size) * size)
        place = ((i % size) * width + j % size).cast("int")
        rows = matrix.df.select(F.floor(i / size).cast("long").alias("bi"), F.floor(j / size).cast("long").alias("bj"), place.alias("p"), "v")
        if full:
            down, across = -(-n // size), -(-m // size)
            every = matrix.df.sparkSession.range(down * across).select(F.floor(F.col("id") / across).cast("long").alias("bi"), (F.col("id") % across).alias("bj"))
            rows = rows.unionByName(every.select("bi", "bj", F.lit(0).alias("p"), F.lit(None).cast("double").alias("v")))
        packed = rows.groupBy("bi", "bj").agg(F.collect_list(F.struct("p", "v")).alias("e"))
        shape = _shape(n, m, size)

        def made(batches):
            for b in batches:
                for bi, bj, e in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("e")):
                    block = np.zeros(shape(bi, bj))
                    v = e.values.field("v").to_numpy(zero_copy_only=False)
                    there = ~np.isnan(v) | np.asarray(e.values.field("v").is_valid())
                    block.ravel()[e.values.field("p").to_numpy()[there]] = v[there]
                    yield bi, bj, block

        return cls(packed.mapInArrow(lambda batches: handed_on(made(batches)), TYPES), n, m, size)

    @classmethod
    def of_rows(cls, df: DataFrame, i: Column | str, values: Column | str, n: int, m: int, size: int = SIZE) -> "Tiles":
        """The tiles of a table with a row's number and its m values as an array; rows may be missing."""
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        rows = df.select(as_col(i).cast("long").alias("i"), as_col(values).cast("array<double>").alias("v"))
        cuts = F.transform(F.sequence(F.lit(0), F.lit((m - 1) // size)), lambda k: F.struct(k.cast("long").alias("bj"), F.slice("v", k * size + 1, F.lit(size)).alias("v")))
        pieces = rows.select("i", F.explode(cuts).alias("c"))
        packed = pieces.groupBy(F.floor(F.col("i") / size).cast("long").alias("bi"), F.col("c.bj").alias("bj")).agg(F.collect_list(F.struct((F.col("i") % size).cast("int").alias("r"), F.col("c.v").alias("v"))).alias("e"))
        shape = _shape(n, m, size)

        def made(batches):
            for b in batches:
                for bi, bj, e in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("e")):
                    block = np.zeros(shape(bi, bj))
                    block[e.values.field("r").to_numpy()] = e.values.field("v").flatten().to_numpy().reshape(len(e), -1)
                    yield bi, bj, block

        return cls(packed.mapInArrow(lambda batches: handed_on(made(batches)), TYPES), n, m, size)

    @classmethod
    def of_vector(cls, x: Vector, size: int = SIZE) -> "Tiles":
        """A dense vector as a matrix of one column."""
        return cls.pack(Matrix(x.to_dense().df.select("i", F.lit(0).cast("long").alias("j"), "v"), x.n, 1), size, full=True)

    # -- forms

    @property
    def down(self) -> int:
        return -(-self.n // self.size)

    @property
    def across(self) -> int:
        return -(-self.m // self.size)

    def shape(self) -> Callable[[int, int], tuple[int, int]]:
        """Rows and columns of the tile at (bi, bj)."""
        return _shape(self.n, self.m, self.size)

    def each(self, f: Callable[[int, int, np.ndarray], np.ndarray], n: int | None = None, m: int | None = None, swap: bool = False) -> "Tiles":
        """The tiles that f makes of (bi, bj, block), at the same places, or mirrored ones."""
        shape = self.shape()

        def made(batches):
            for b in batches:
                for bi, bj, raw in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("block")):
                    block = f(bi, bj, block_of(raw.as_py(), shape(bi, bj)[0]))
                    yield (bj, bi, block) if swap else (bi, bj, block)

        return Tiles(self.df.mapInArrow(lambda batches: handed_on(made(batches)), TYPES), self.n if n is None else n, self.m if m is None else m, self.size)

    def transpose(self) -> "Tiles":
        return self.each(lambda bi, bj, b: b.T, self.m, self.n, swap=True)

    def scale(self, s: float) -> "Tiles":
        return self.each(lambda bi, bj, b: s * b)

    def where(self, condition: Column | str) -> "Tiles":
        """Some tiles; the others are 0."""
        return replace(self, df=self.df.filter(condition))

    def filled(self) -> "Tiles":
        """With tiles of zeros where there are none."""
        shape, down, across = self.shape(), self.down, self.across
        every = self.df.sparkSession.range(down * across).select(F.expr(f"id div {across}").alias("bi"), (F.col("id") % across).alias("bj"))
        parts = self.df.unionByName(every.select("bi", "bj", F.lit(None).cast("binary").alias("block")))
        one = parts.groupBy("bi", "bj").agg(F.max("block").alias("block"))

        def made(batches):
            for b in batches:
                for bi, bj, raw in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("block")):
                    yield bi, bj, block_of(raw.as_py(), shape(bi, bj)[0]) if raw.is_valid else np.zeros(shape(bi, bj))

        return replace(self, df=one.mapInArrow(lambda batches: handed_on(made(batches)), TYPES))

    def entries(self) -> Matrix:
        """As triples, zeros of stored tiles included."""
        shape, size = self.shape(), self.size
        schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())])

        def run(batches):
            for b in batches:
                for bi, bj, raw in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("block")):
                    rows, columns = shape(bi, bj)
                    i = np.repeat(np.arange(rows) + bi * size, columns)
                    j = np.tile(np.arange(columns) + bj * size, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.frombuffer(raw.as_py(), np.float64))], schema=schema)

        return Matrix(self.df.mapInArrow(run, "i long, j long, v double"), self.n, self.m)

    def vector(self) -> Vector:
        """The first column."""
        return Vector(self.entries().df.filter("j = 0").select("i", "v"), self.n, 0.0, False).to_dense()

    # -- sums and products

    def plus(self, other: "Tiles", a: float = 1.0, b: float = 1.0) -> "Tiles":
        """a * self + b * other: one shuffle of both."""
        left, right = (x if f == 1 else x.scale(f) for x, f in ((self, a), (other, b)))
        return replace(self, df=summed(left.df.unionByName(right.df), self.shape()))

    def matmul(self, other: "Tiles", a: float = 1.0, c: "Tiles | None" = None, b: float = 0.0) -> "Tiles":
        """a * A B + b * C."""
        if self.m != other.n or self.size != other.size:
            raise ValueError(f"{self.n} x {self.m} by {self.size} and {other.n} x {other.m} by {other.size}")
        left = self.df.select("bi", F.col("bj").alias("k"), F.col("block").alias("x"))
        right = other.df.select(F.col("bi").alias("k"), "bj", F.col("block").alias("y"))
        made = replace(self, m=other.m)
        parts = products(left.join(right, "k"), self.shape(), other.shape(), a)
        if c is not None and b != 0:
            parts = parts.unionByName(c.scale(b).df)
        return replace(made, df=summed(parts, made.shape()))

    def matmul_sparse(self, other: Matrix, a: float = 1.0) -> "Tiles":
        """a * A B for a sparse B of triples: its entries travel as they are and become blocks in the tasks."""
        size, mine, its = self.size, self.shape(), _shape(other.n, other.m, self.size)
        i, j = F.col("i"), F.col("j")
        entry = F.struct((i % size).cast("int").alias("r"), (j % size).cast("int").alias("c"), F.col("v"))
        right = other.df.groupBy(F.floor(i / size).cast("long").alias("k"), F.floor(j / size).cast("long").alias("bj")).agg(F.collect_list(entry).alias("e"))
        left = self.df.select("bi", F.col("bj").alias("k"), F.col("block").alias("x"))

        def product(b: pa.RecordBatch, r: int) -> np.ndarray:
            bi, k, bj = (b.column(c)[r].as_py() for c in ("bi", "k", "bj"))
            e, y = b.column("e")[r].values, np.zeros(its(k, bj))
            y[e.field("r").to_numpy(), e.field("c").to_numpy()] = e.field("v").to_numpy()
            return a * (block_of(b.column("x")[r].as_py(), mine(bi, k)[0]) @ y)

        made = replace(self, m=other.m)
        return replace(made, df=summed(left.join(right, "k").mapInArrow(_accumulated(product), TYPES), made.shape()))

    def gramian(self) -> "Tiles":
        """The transpose times the matrix. A matrix no wider than a tile is not shuffled: only sums are."""
        if self.across > 1:
            return self.transpose().matmul(self)
        shape = self.shape()

        def product(b: pa.RecordBatch, r: int) -> np.ndarray:
            x = block_of(b.column("x")[r].as_py(), shape(b.column("k")[r].as_py(), 0)[0])
            return x.T @ x

        rows = self.df.select(F.lit(0).cast("long").alias("bi"), F.lit(0).cast("long").alias("bj"), F.col("bi").alias("k"), F.col("block").alias("x"))
        made = replace(self, n=self.m)
        return replace(made, df=summed(rows.mapInArrow(_accumulated(product), TYPES), made.shape()))


def _shape(n: int, m: int, size: int) -> Callable[[int, int], tuple[int, int]]:
    return lambda bi, bj: (min(size, n - bi * size), min(size, m - bj * size))


def _accumulated(product: Callable[[pa.RecordBatch, int], np.ndarray]):
    """Sums by (bi, bj) of what product makes of the rows of a task; those held are handed on when they reach HELD bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for b in batches:
            bi, bj = b.column("bi").to_pylist(), b.column("bj").to_pylist()
            for r in range(b.num_rows):
                made, at = product(b, r), (bi[r], bj[r])
                if at in held:
                    held[at] += made
                else:
                    held[at], size = made, size + made.nbytes
                if size > HELD:
                    yield tile_batch([(*k, v) for k, v in held.items()])
                    held, size = {}, 0
        if held:
            yield tile_batch([(*k, v) for k, v in held.items()])

    return run


def products(pairs: DataFrame, left: Callable, right: Callable, a: float = 1.0) -> DataFrame:
    """a * x y of rows (bi, k, bj, x, y), added up within each task."""

    def product(b: pa.RecordBatch, r: int) -> np.ndarray:
        bi, k, bj = (b.column(c)[r].as_py() for c in ("bi", "k", "bj"))
        return a * (block_of(b.column("x")[r].as_py(), left(bi, k)[0]) @ block_of(b.column("y")[r].as_py(), right(k, bj)[0]))

    return pairs.select("bi", "k", "bj", "x", "y").mapInArrow(_accumulated(product), TYPES)


def summed(parts: DataFrame, shape: Callable) -> DataFrame:
    """Tiles of the same place added up, one after another."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def made(batches):
        at, total = None, None
        for b in batches:
            for bi, bj, raw in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("block")):
                block = block_of(raw.as_py(), shape(bi, bj)[0])
                if (bi, bj) == at:
                    total = total + block
                    continue
                if at is not None:
                    yield *at, total
                at, total = (bi, bj), block
        if at is not None:
            yield *at, total

    return parts.repartition(n, "bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(lambda batches: handed_on(made(batches)), TYPES)
