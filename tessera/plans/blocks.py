"""Fields over a grid as a table of blocks (b, block), each block a binary of row-major doubles.

A stencil needs of other blocks only the layers next to a block: its faces. Blocks stay where they
are (a table in buckets of b), faces are sent, and a join by b puts them around their block. Blocks
at the upper ends of the grid are as small as the grid ends.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.grid import Grid, Stencil
from tessera.plans.storage import run_dir
from tessera.plans.vector import Vector

#: Values of a block unless its sides are given.
CELLS = 65_536
TYPES = "b long, block binary"

_FACE = "b long, at array<int>, extent array<int>, face binary"
_FACES = pa.schema([("b", pa.int64()), ("at", pa.list_(pa.int32())), ("extent", pa.list_(pa.int32())), ("face", pa.binary())])


def sides(grid: Grid, cells: int = CELLS) -> tuple[int, ...]:
    """Sides of a block of about so many values, as equal as the grid lets them be."""
    found, left = [0] * len(grid.shape), cells
    for done, k in enumerate(sorted(range(len(grid.shape)), key=lambda k: grid.shape[k])):
        found[k] = max(1, min(grid.shape[k], int(left ** (1 / (len(grid.shape) - done)) + 1e-9)))
        left = max(1, left // found[k])
    return tuple(found)


@dataclass(frozen=True)
class _Cut:
    """How a grid is cut into blocks, and where the faces of one lie around others."""

    shape: tuple[int, ...]
    side: tuple[int, ...]
    wraps: tuple[bool, ...]

    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // s) for n, s in zip(self.shape, self.side))

    def place(self, b: int) -> tuple[int, ...]:
        return tuple(int(x) for x in np.unravel_index(b, self.counts()))

    def extent(self, b: int) -> tuple[int, ...]:
        return tuple(min(s, n - p * s) for p, n, s in zip(self.place(b), self.shape, self.side))

    def along(self, k: int, at: int, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
        """(target, -1 below it, 0 itself or 1 above it, first place from the target's begin, first place of the source, length) in dimension k.

        Targets look at low places below and high places above themselves; where the grid wraps, the
        source is also there again a whole turn (or several) away.
        """
        n, side, last = self.shape[k], self.side[k], -(-self.shape[k] // self.side[k]) - 1
        begin, end = at * side, min((at + 1) * side, n)
        found = [(at, 0, 0, 0, end - begin)]
        turns = max(low, high) // n + 1 if self.wraps[k] else 0
        for w in range(-turns * n, turns * n + 1, n):
            for t in range(max(0, (begin + w - high) // side - 1), min(last, (end + w + low - 1) // side) + 1):
                t0, t1 = t * side, min((t + 1) * side, n)
                for sign, a, z in ((-1, max(begin + w, t0 - low), min(end + w, t0)), (1, max(begin + w, t1), min(end + w, t1 + high))):
                    if a < z:
                        found.append((t, sign, a - t0, a - w - begin, z - a))
        return found


def _reach(points) -> tuple[list[int], list[int]]:
    """How far a stencil looks down and up in each dimension."""
    offsets = list(zip(*(o for o, _ in points)))
    return [max(0, -min(o)) for o in offsets], [max(0, max(o)) for o in offsets]


def _looks(points, signs: tuple[int, ...]) -> bool:
    """Whether a point of the stencil lies on that side in each dimension with a sign."""
    return any(all(s == 0 or o * s > 0 for o, s in zip(offset, signs)) for offset, _ in points)


@dataclass(frozen=True)
class Blocks:
    """df (b, block): every block of the grid is there once."""

    df: DataFrame
    grid: Grid
    side: tuple[int, ...]

    @property
    def _cut(self) -> _Cut:
        return _Cut(self.grid.shape, self.side, tuple(self.grid.wraps(k) for k in range(len(self.grid.shape))))

    @property
    def count(self) -> int:
        return math.prod(self._cut.counts())

    # -- making

    @classmethod
    def pack(cls, x: Vector, grid: Grid, side: tuple[int, ...] | None = None) -> "Blocks":
        """A vector's values in the order of the grid; those that are missing or null are 0. A block's values are one group of its size at most."""
        if x.n > grid.size:
            raise ValueError(f"{x.n} values on a grid of {grid.size}")
        side = tuple(side or sides(grid))
        if len(side) != len(grid.shape) or min(side) < 1:
            raise ValueError(f"blocks of {side} on a grid of {grid.shape}")
        empty = cls(x.df, grid, side)
        counts, at = empty._cut.counts(), grid.dims(F.col("i"))
        of_block = [F.floor(c / s).cast("long") for c, s in zip(at, side)]
        widths = [F.least(F.lit(s).cast("long"), F.lit(n) - q * s) for q, n, s in zip(of_block, grid.shape, side)]
        inner = F.lit(0).cast("long")
        for c, s, width in zip(at, side, widths):
            inner = inner * width + c % s
        rows = x.df.filter("v is not null").select(Grid(counts).position(of_block).alias("b"), inner.cast("int").alias("p"), "v")
        every = x.df.sparkSession.range(empty.count).select(F.col("id").alias("b"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("double").alias("v"))
        entries = F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "v")))
        packed = rows.unionByName(every).groupBy("b").agg(entries.alias("e"))
        cut = empty._cut

        @F.arrow_udf("binary")
        def fill(b: pa.Array, e: pa.Array) -> pa.Array:
            made = []
            for k, held in zip(b.to_pylist(), e):
                block = np.zeros(math.prod(cut.extent(k)))
                if len(held):
                    block[held.values.field("p").to_numpy(zero_copy_only=False)] = held.values.field("v").to_numpy(zero_copy_only=False)
                made.append(block.tobytes())
            return pa.array(made, pa.binary())

        return replace(empty, df=packed.select("b", fill("b", "e").alias("block")))

    def unpack(self) -> Vector:
        """The values as a vector."""
        cut, strides = self._cut, self.grid.strides()

        def run(batches):
            for batch in batches:
                for b, raw in zip(batch.column("b").to_pylist(), batch.column("block")):
                    extent = cut.extent(b)
                    i = np.zeros(extent, np.int64)
                    for k, (place, s, stride) in enumerate(zip(cut.place(b), cut.side, strides)):
                        i += ((place * s + np.arange(extent[k])) * stride).reshape([-1 if d == k else 1 for d in range(len(extent))])
                    yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(np.frombuffer(raw.as_buffer(), np.float64))], names=["i", "v"])

        return Vector(self.df.mapInArrow(run, "i long, v double"), self.grid.size)

    def keep(self) -> "Blocks":
        """The blocks as a table in the shared folder, in buckets of b: lineage ends, and joins by b don't move them.

        Nothing is shuffled for it: packed blocks are dealt by b already, as are results of kept ones, so that a task writes its own buckets.
        """
        spark = self.df.sparkSession
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"blocks_{uuid.uuid4().hex}"
        self.df.write.option("compression", "lz4").option("path", f"{run_dir(spark)}/{name}").bucketBy(n, "b").saveAsTable(name)
        held = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay
        return replace(self, df=held)

    # -- work

    def combine(self, f: Callable[..., np.ndarray], *others: "Blocks") -> "Blocks":
        """f of the blocks (read-only arrays) at each place; of kept ones none is moved."""
        for o in others:
            if (o.grid.shape, o.side) != (self.grid.shape, self.side):
                raise ValueError("fields are cut into different blocks")
        cut, names = self._cut, [f"block{k}" for k in range(len(others))]
        rows = self.df
        for o, name in zip(others, names):
            rows = rows.join(o.df.select("b", F.col("block").alias(name)).hint("merge"), "b")

        @F.arrow_udf("binary")
        def run(b: pa.Array, *blocks: pa.Array) -> pa.Array:
            made = [np.ascontiguousarray(f(*(np.frombuffer(r.as_buffer(), np.float64).reshape(cut.extent(k)) for r in raw)), np.float64) for k, *raw in zip(b.to_pylist(), *blocks)]
            return pa.array([m.tobytes() for m in made], pa.binary())

        return replace(self, df=rows.select("b", run("b", "block", *names).alias("block")))

    def fold(self, f: Callable[..., float], *others: "Blocks") -> DataFrame:
        """One row with the sum v of f over the blocks at each place."""
        sums = self.combine(lambda *blocks: np.array([f(*blocks)]), *others).df
        number = F.arrow_udf("double")(_first)
        return sums.select(number("block").alias("v")).agg(F.sum("v").alias("v"))

    def faces(self, stencil: Stencil) -> DataFrame:
        """(b, at, extent, face): the layers that block b needs of others, at places counted from its first one."""
        cut, points = self._cut, stencil.points
        low, high = _reach(points)

        def run(batches):
            for batch in batches:
                for b, raw in zip(batch.column("b").to_pylist(), batch.column("block")):
                    block = np.frombuffer(raw.as_buffer(), np.float64).reshape(cut.extent(b))
                    out = []
                    for parts in itertools.product(*(cut.along(k, at, low[k], high[k]) for k, at in enumerate(cut.place(b)))):
                        signs = tuple(p[1] for p in parts)
                        if any(signs) and _looks(points, signs):
                            layer = block[tuple(slice(p[3], p[3] + p[4]) for p in parts)]
                            to = int(np.ravel_multi_index([p[0] for p in parts], cut.counts()))
                            out.append((to, [p[2] for p in parts], layer.shape, layer.tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FACES.types)], schema=_FACES)

        return self.df.mapInArrow(run, _FACE)

    def stencil(self, stencil: Stencil) -> "Blocks":
        """The stencil's matrix times the field. Only faces are shuffled if the blocks are kept: without it they are made twice."""
        cut, points = self._cut, stencil.points
        low, high = _reach(points)
        around = self.faces(stencil).groupBy("b").agg(F.collect_list(F.struct("at", "extent", "face")).alias("faces"))

        @F.arrow_udf("binary")
        def run(b: pa.Array, block: pa.Array, faces: pa.Array) -> pa.Array:
            made = []
            for k, raw, near in zip(b.to_pylist(), block, faces.to_pylist()):
                extent = cut.extent(k)
                wide = np.zeros([lo + n + hi for lo, n, hi in zip(low, extent, high)])
                wide[tuple(slice(lo, lo + n) for lo, n in zip(low, extent))] = np.frombuffer(raw.as_buffer(), np.float64).reshape(extent)
                for f in near or ():
                    wide[tuple(slice(lo + a, lo + a + n) for lo, a, n in zip(low, f["at"], f["extent"]))] = np.frombuffer(f["face"], np.float64).reshape(f["extent"])
                total = np.zeros(extent)
                for offset, weight in points:
                    total += weight * wide[tuple(slice(lo + o, lo + o + n) for lo, o, n in zip(low, offset, extent))]
                made.append(total.tobytes())
            return pa.array(made, pa.binary())

        rows = self.df.join(around.hint("merge"), "b", "left")
        return replace(self, df=rows.select("b", run("b", "block", "faces").alias("block")))

    def steps(self, stencil: Stencil, n: int) -> "Blocks":
        """The stencil applied n times; each field is kept."""
        held = self.keep()
        for k in range(n):
            held = held.stencil(stencil)
            held = held.keep() if k < n - 1 else held
        return held


def _first(block: pa.Array) -> pa.Array:
    return pa.array([float(np.frombuffer(r.as_buffer(), np.float64)[0]) for r in block], pa.float64())


def conjugate_gradients(stencil: Stencil, right: Blocks, steps: int = 500, eps: float = 1e-8) -> tuple[Blocks, list[float]]:
    """(x, norms of the residual) with the stencil's matrix (symmetric, positive definite) times x = right.

    Fields are tables of blocks; a step sends faces and two sums.
    """
    add = lambda s: lambda x, y: x + s * y
    dot = lambda x, y: float(np.vdot(x, y))
    right = right.keep()
    x, r, p = right.combine(np.zeros_like).keep(), right, right
    rr = r.fold(dot, r).first()[0] or 0.0
    norms = [math.sqrt(rr)]
    while norms[-1] > eps * norms[0] and len(norms) <= steps:
        q = p.stencil(stencil).keep()
        curve = p.fold(dot, q).first()[0]
        if curve <= 0:
            raise ValueError("the stencil's matrix isn't positive definite")
        x, r = x.combine(add(rr / curve), p).keep(), r.combine(add(-rr / curve), q).keep()
        before, rr = rr, r.fold(dot, r).first()[0]
        p = r.combine(add(rr / before), p).keep()
        norms.append(math.sqrt(rr))
    return x, norms
