"""Products of large sparse matrices: a task makes those of a region of inner indexes and sums them in arrays.

Entries of both sides go to their region once, as they are. What a region adds to a tile of the result
is one record of places and values, so that neither pairs of entries nor rows of unfinished sums
are shuffled, and tiles are added up one after another.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: Inner indexes of a region at most, and those from which on products are made so.
REGION, LEAST = 1 << 16, 1 << 14
#: Entries that are multiplied at once (or one inner index), and products that are made at once.
CHUNK, MADE = 1 << 20, 1 << 20
#: Rows and columns of a tile of the result; tiles whose sums a task holds, and products of one step that make it worth that.
TILE, HELD, SOME = 512, 48, 2048

Values = list[np.ndarray]


def real(x: Values, y: Values) -> Values:
    return [x[0] * y[0]]


def complex_(x: Values, y: Values) -> Values:
    return [x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0]]


def _dealt(df: DataFrame, other: DataFrame, side: int, at: str, step: int, hot: int, values: list[str]) -> DataFrame:
    """(region, part, share, k, side, at, ...): an index with more than hot entries is dealt over several tasks, to which the other side's entries go, too."""
    shares = lambda of, name: of.groupBy("k").agg(F.ceil(F.count("*") / hot).cast("int").alias(name)).filter(c(name) > 1)
    rows = df.join(F.broadcast(shares(df, "mine")), "k", "left").join(F.broadcast(shares(other, "its")), "k", "left")
    mine = F.pmod(F.xxhash64(at), F.coalesce("mine", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("its", F.lit(1)) - 1))
    names = ("part", "share") if side == 0 else ("share", "part")
    return rows.select(F.expr(f"k div {step}").alias("region"), mine.alias(names[0]), every.alias(names[1]), "k", F.lit(side).alias("side"), c(at).alias("at"), *values).select("region", "part", "share", "k", "side", "at", *values)


def _packed(a: np.ndarray) -> bytes:
    """An array with bytes of equal weight side by side, which are often alike."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def _unpacked(raw: pa.Scalar, kind: type) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw.as_buffer()), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _made(i: np.ndarray, li: np.ndarray, x: Values, j: np.ndarray, lj: np.ndarray, y: Values, multiply: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, Values]]:
    """(i, j, products) of the pairs of entries (i, x) and (j, y) of equal inner indexes li and lj, both sorted by these."""
    first = np.searchsorted(lj, li, "left")
    many = np.searchsorted(lj, li, "right") - first
    ends = np.cumsum(many)
    for low in range(0, int(ends[-1]) if len(ends) else 0, MADE):
        # pair p is that of the entry left, and of the right entry that many after its first
        p = np.arange(low, min(int(ends[-1]), low + MADE))
        left = np.searchsorted(ends, p, "right")
        right = first[left] + p - (ends[left] - many[left])
        yield i[left], j[right], multiply([v[left] for v in x], [v[right] for v in y])


class _Tiles:
    """Sums of tiles of the result that many products fall into; of others those of one call are handed on."""

    def __init__(self, many: int, schema: pa.Schema):
        self.many, self.schema, self.held = many, schema, {}

    def add(self, i: np.ndarray, j: np.ndarray, made: Values) -> Iterator[pa.RecordBatch]:
        tiles, tile = np.unique((i // TILE) << 32 | j // TILE, return_inverse=True)
        order = np.argsort(tile.astype(np.int16) if len(tiles) < 1 << 15 else tile, kind="stable")
        place, made = (i % TILE * TILE + j % TILE)[order], [v[order] for v in made]
        ends = np.concatenate(([0], np.cumsum(np.bincount(tile))))
        loose = []
        for n, key in enumerate(tiles.tolist()):
            low, high = int(ends[n]), int(ends[n + 1])
            if key not in self.held and high - low < SOME:
                found, of = np.unique(place[low:high], return_inverse=True)
                loose.append((key, found, [np.bincount(of, v[low:high], len(found)) for v in made]))
                continue
            if key not in self.held:
                if len(self.held) >= HELD:
                    yield from self.flush()
                self.held[key] = [np.zeros(TILE * TILE, bool), *(np.zeros(TILE * TILE) for _ in range(self.many))]
            met, *sums = self.held[key]
            met[place[low:high]] = True
            for s, v in zip(sums, made):
                s += np.bincount(place[low:high], v[low:high], TILE * TILE)
        yield from self.records(loose)

    def flush(self) -> Iterator[pa.RecordBatch]:
        whole = []
        for key, (met, *sums) in self.held.items():
            found = np.flatnonzero(met)
            whole.append((key, found, [s[found] for s in sums]))
        self.held.clear()
        yield from self.records(whole)

    def records(self, pieces: list) -> Iterator[pa.RecordBatch]:
        for n in range(0, len(pieces), 16):
            some = pieces[n : n + 16]
            columns = [[k >> 32 for k, _, _ in some], [k & 0xFFFFFFFF for k, _, _ in some], [_packed(np.diff(at, prepend=0).astype(np.int32)) for _, at, _ in some]]
            columns += [[_packed(sums[m]) for _, _, sums in some] for m in range(self.many)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, self.schema)], schema=self.schema)


def _pieces(multiply: Callable, many: int, schema: pa.Schema):
    """Entries, sorted by region, part, share and k, as pieces of tiles (bi, bj, at, values): places as differences, and sums."""

    def pieces(tiles: _Tiles, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k, side, at, *values = (np.concatenate(x) for x in zip(*held))
        left, right = side == 0, side == 1
        for i, j, made in _made(at[left], k[left], [v[left] for v in values], at[right], k[right], [v[right] for v in values], multiply):
            yield from tiles.add(i, j, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, key, last, held, count = _Tiles(many, schema), None, None, [], 0
        for batch in batches:
            region, part, share, *rest = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            k = rest[0]
            new = (np.diff(region) != 0) | (np.diff(part) != 0) | (np.diff(share) != 0)
            ends = [0, *(np.flatnonzero(new | (np.diff(k) != 0)) + 1).tolist(), len(k)]
            begin = 0
            for low, high in zip(ends, ends[1:]):
                now = (region[low], part[low], share[low]) if low < high else key
                if held or low > begin:
                    full = count + low - begin >= CHUNK and (k[low] != last if low == 0 else True)
                    if now != key or full:
                        if low > begin:
                            held.append([x[begin:low] for x in rest])
                        if held:
                            yield from pieces(tiles, held)
                        held, count, begin = [], 0, low
                key = now
            if len(k) > begin:
                held.append([x[begin:] for x in rest])
                count += len(k) - begin
                last = k[-1]
        if held:
            yield from pieces(tiles, held)
        yield from tiles.flush()

    return run


def _whole(many: int, schema: pa.Schema):
    """Pieces, sorted by tile, as rows (i, j, v0, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, met = None, None, None

        def rows() -> pa.RecordBatch:
            found = np.flatnonzero(met)
            return pa.RecordBatch.from_arrays([pa.array(key[0] * TILE + found // TILE), pa.array(key[1] * TILE + found % TILE), *(pa.array(s[found]) for s in sums)], schema=schema)

        for batch in batches:
            for bi, bj, *raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(n) for n in range(2, 3 + many))):
                if (bi, bj) != key:
                    if key is not None:
                        yield rows()
                    key, sums, met = (bi, bj), [np.zeros(TILE * TILE) for _ in range(many)], np.zeros(TILE * TILE, bool)
                at = np.cumsum(_unpacked(raw[0], np.int32))
                met[at] = True
                for s, v in zip(sums, raw[1:]):
                    s[at] += _unpacked(v, np.float64)
        if key is not None:
            yield rows()

    return run


def by_regions(left: DataFrame, right: DataFrame, inner: int, multiply: Callable, values: list[str], hot: int) -> DataFrame:
    """(i, j, values) of left (i, k, values) times right (k, j, values), with k below inner; places whose products cancel are there."""
    spark, many = left.sparkSession, len(values)
    tasks = max(1, 2 * spark.sparkContext.defaultParallelism, -(-inner // REGION))
    step = max(1, -(-inner // tasks))
    both = _dealt(left, right, 0, "i", step, hot, values).unionByName(_dealt(right, left, 1, "j", step, hot, values))
    sorted_ = both.repartition(tasks, "region", "part", "share").sortWithinPartitions("region", "part", "share", "k")
    piece = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("at", pa.binary()), *((v, pa.binary()) for v in values)])
    pieces = sorted_.mapInArrow(_pieces(multiply, many, piece), "bi long, bj long, at binary, " + ", ".join(f"{v} binary" for v in values))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = pa.schema([("i", pa.int64()), ("j", pa.int64()), *((v, pa.float64()) for v in values)])
    return pieces.repartition(n, "bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_whole(many, out), "i long, j long, " + ", ".join(f"{v} double" for v in values))
