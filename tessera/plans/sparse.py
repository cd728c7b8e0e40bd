"""Sparse matrices that are kept for many products: tiles of entries, which wait where blocks of a vector are sent.

A tile has the entries of a range of rows and of BLOCK columns as three arrays. All tiles of a range
of rows are one bucket of a written table; a product packs the vector into blocks, sends each to the
ranges that have entries in its columns, and adds up a range in one task. So a product shuffles values
of the vector, once for each range that needs them, and no products of entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.storage import cut, in_buckets, shuffled
from tessera.plans.vector import Vector

c = F.col
#: Columns of a tile, hence values of a vector's block.
BLOCK = 1 << 16
#: Entries of a matrix from which on it is worth packing.
PACKED = 1 << 22
#: Entries of a range of rows, and of one record of a tile.
RANGE, PIECE = 1 << 23, 1 << 18

_TILE = "g long, first long, size int, b long, rows binary, cols binary, vals binary"
_TILES = pa.schema([("g", pa.int64()), ("first", pa.int64()), ("size", pa.int32()), ("b", pa.int64()), ("rows", pa.binary()), ("cols", pa.binary()), ("vals", pa.binary())])
_BLOCKS = pa.schema([("b", pa.int64()), ("block", pa.binary())])


def _labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a table in n buckets has in n different ones, so that none is empty."""
    found = spark.range(32 * n * n.bit_length() + 32).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("g")).collect()  # a row a bucket
    if len(found) < n:
        raise ValueError(f"labels of {len(found)} of {n} buckets")
    return [r.g for r in found]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (g, first, size, b, r, k, v), sorted by g and b, as records of PIECE entries at most."""
    key, held, count = None, [], 0

    def record() -> pa.RecordBatch:
        rows, cols, vals = (np.concatenate([h[n] for h in held]) for n in range(3))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, rows.tobytes(), cols.tobytes(), vals.tobytes()), _TILES)], schema=_TILES)

    for batch in batches:
        g, first, size, b, r, k, v = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        ends = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(b) != 0)) + 1), len(g)]
        for low, high in zip(ends, ends[1:]):
            if low == high:
                continue
            now = (int(g[low]), int(first[low]), int(size[low]), int(b[low]))
            if held and (now != key or count >= PIECE):
                yield record()
                held, count = [], 0
            key, count = now, count + high - low
            held.append((r[low:high].astype(np.int32), k[low:high].astype(np.int32), v[low:high].astype(np.float64)))
    if held:
        yield record()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values (b, k, y) as blocks; a task has all values of its blocks."""
    made: dict[int, np.ndarray] = {}
    for batch in batches:
        b, k, y = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        order = np.argsort(b, kind="stable")
        ends = [0, *(np.flatnonzero(np.diff(b[order])) + 1), len(b)]
        for low, high in zip(ends, ends[1:]):
            if low < high:
                at = order[low:high]
                made.setdefault(int(b[at[0]]), np.zeros(BLOCK))[k[at]] = y[at]
    for b, block in made.items():
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([block.tobytes()], pa.binary())], schema=_BLOCKS)


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, size, rows, cols, vals, block) as sums (i, v) of all rows of each range."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for first, size, *raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(k) for k in range(2, 6))):
            rows, cols, vals, x = (np.frombuffer(r.as_buffer(), t) for r, t in zip(raw, (np.int32, np.int32, np.float64, np.float64)))
            part = np.bincount(rows, vals * x[cols], size)
            sums[first] = sums[first] + part if first in sums else part
    for first, total in sums.items():
        for low in range(0, len(total), 1 << 16):
            v = total[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + low, first + low + len(v))), pa.array(v)], names=["i", "v"])


def _many_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values (b, r, k, y), sorted by b and k, as records (b, places, ks, values) of PIECE values at most."""
    for batch in batches:
        b, r, k, y = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        ends = [0, *(np.flatnonzero(np.diff(b)) + 1), len(b)]
        for low, high in zip(ends, ends[1:]):
            for at in range(low, high, PIECE):
                to = min(high, at + PIECE)
                held = (r[at:to].astype(np.int32), k[at:to].astype(np.int64), y[at:to].astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([int(b[low])]), *(pa.array([h.tobytes()], pa.binary()) for h in held)], names=["b", "places", "ks", "values"])


def _multiplied_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, size, rows, cols, vals, places, ks, values) as sums (i, k, v) of each range, where there are products."""
    sums: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for first, size, *raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(k) for k in range(2, 8))):
            rows, cols, vals, places, ks, values = (np.frombuffer(r.as_buffer(), t) for r, t in zip(raw, (np.int32, np.int32, np.float64, np.int32, np.int64, np.float64)))
            ends = [0, *(np.flatnonzero(np.diff(ks)) + 1), len(ks)]
            for low, high in zip(ends, ends[1:]):
                x, there = np.zeros(BLOCK), np.zeros(BLOCK, bool)
                x[places[low:high]], there[places[low:high]] = values[low:high], True
                met = there[cols]
                total, seen = sums.setdefault((first, int(ks[low])), [np.zeros(size), np.zeros(size, bool)])
                total += np.bincount(rows[met], vals[met] * x[cols[met]], size)
                seen[rows[met]] = True
    for (first, k), (total, seen) in sums.items():
        found = np.flatnonzero(seen)
        for low in range(0, len(found), 1 << 16):
            at = found[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(np.full(len(at), k)), pa.array(total[at])], names=["i", "k", "v"])


@dataclass(frozen=True)
class Held(Matrix):
    """A matrix, a written table, whose form for products is made once; one of few entries is dealt by what a product joins and kept by the executors."""

    made: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def of(cls, m: Matrix) -> "Held":
        return m if isinstance(m, Held) else cls(cut(m.df.select("i", "j", "v")), m.n, m.m)

    def release(self) -> None:
        for form in self.made.values():
            if isinstance(form, DataFrame):
                form.unpersist()
        self.made.clear()

    def sums(self, x: DataFrame, transposed: bool = False) -> DataFrame:
        """(i, v) of the product with x (i, v), in which what is not there is 0; rows without entries may be left out."""
        if transposed not in self.made:
            if "entries" not in self.made:
                self.made["entries"] = self.df.count()
            self.made[transposed] = self._tiles(transposed) if self.made["entries"] >= PACKED else self._dealt(transposed)
        form, m = self.made[transposed], self.n if transposed else self.m
        if isinstance(form, DataFrame):
            return form.join(shuffled(x.select(c("i").alias("at"), c("v").alias("y")), m), "at").groupBy(c("row").alias("i")).agg(F.sum(c("e") * c("y")).alias("v"))
        tiles, needs, groups = form
        parts = min(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-m // BLOCK))
        blocks = x.select(F.expr(f"i div {BLOCK}").alias("b"), (c("i") % BLOCK).cast("int").alias("k"), c("v").alias("y")).repartition(parts, "b").mapInArrow(_blocks, "b long, block binary")
        sent = blocks.join(F.broadcast(needs), "b").repartition(groups, "g").select(c("g").alias("to"), c("b").alias("at"), "block")
        # the block is compared by inequalities, as a second key of the join would have the tiles shuffled
        met = tiles.join(sent.hint("merge"), (c("g") == c("to")) & (c("b") <= c("at")) & (c("b") >= c("at")))
        return met.select("first", "size", "rows", "cols", "vals", "block").mapInArrow(_multiplied, "i long, v double")

    def times_many(self, others: DataFrame) -> DataFrame:
        """A X for vectors side by side, (i, k, v): tiles meet blocks of values of all vectors; a task holds the sums of its range of rows."""
        if "tiles" not in self.made:
            self.made.setdefault("entries", self.df.count())
            self.made["tiles"] = self._tiles(False)
        tiles, needs, groups = self.made["tiles"]
        parts = min(int(others.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.m // BLOCK))
        values = others.select(F.expr(f"i div {BLOCK}").alias("b"), (c("i") % BLOCK).cast("int").alias("r"), c("k").cast("long").alias("k"), c("v").alias("y"))
        blocks = values.repartition(parts, "b").sortWithinPartitions("b", "k").mapInArrow(_many_blocks, "b long, places binary, ks binary, values binary")
        sent = blocks.join(F.broadcast(needs), "b").repartition(groups, "g").select(c("g").alias("to"), c("b").alias("at"), "places", "ks", "values")
        met = tiles.join(sent.hint("merge"), (c("g") == c("to")) & (c("b") <= c("at")) & (c("b") >= c("at")))
        return met.select("first", "size", "rows", "cols", "vals", "places", "ks", "values").mapInArrow(_multiplied_many, "i long, k long, v double")

    def _dealt(self, transposed: bool) -> DataFrame:
        """The entries (row, at, e), dealt by the index that a product joins by."""
        row, col = ("j", "i") if transposed else ("i", "j")
        parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.df.select(c(row).alias("row"), c(col).alias("at"), c("v").alias("e")).repartition(parts, "at").persist(StorageLevel.MEMORY_AND_DISK)

    def _tiles(self, transposed: bool) -> tuple[DataFrame, DataFrame, int]:
        """The tiles, in buckets of their range of rows; (g, b) of those that there are; the number of buckets."""
        spark = self.df.sparkSession
        row, col, n = ("j", "i", self.m) if transposed else ("i", "j", self.n)
        most = max(2 * spark.sparkContext.defaultParallelism, -(-self.made["entries"] // RANGE))
        size = -(-n // max(1, min(most, n)))
        groups = -(-n // size)
        labels = F.array(*map(F.lit, _labels(spark, groups)))
        at = F.expr(f"{row} div {size}")
        entries = self.df.select(F.element_at(labels, (at + 1).cast("int")).alias("g"), (at * size).alias("first"), F.lit(size).alias("size"), F.expr(f"{col} div {BLOCK}").alias("b"), (c(row) % size).cast("int").alias("r"), (c(col) % BLOCK).cast("int").alias("k"), "v")
        entries = entries.withColumn("size", F.least(c("size").cast("long"), F.lit(n) - c("first")).cast("int"))
        tiles = in_buckets(entries.repartition(groups, "g").sortWithinPartitions("g", "b").mapInArrow(_packed, _TILE), "g", groups)
        return tiles, cut(tiles.select("g", "b").distinct().coalesce(1)), groups

    def times(self, x: Vector, a: float = 1.0, y: Vector | None = None, b: float = 0.0, transposed: bool = False) -> Vector:
        if a == 0:
            return Matrix(self.df, self.n, self.m).times(x, a, y, b, transposed)
        n = self.m if transposed else self.n
        base = y.to_dense().scalar("mult", b).df if y is not None and b != 0 else self.df.sparkSession.range(n).select(c("id").alias("i"), F.lit(0.0).alias("v"))
        x = x if x.dense or x.zero == 0 else x.to_dense()
        products = self.sums(x.df, transposed).select("i", (F.lit(float(a)) * c("v")).alias("v"))
        return Vector(products.unionByName(base).groupBy("i").agg(F.sum("v").alias("v")), n)
