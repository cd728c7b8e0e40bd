"""Owner functions of distributions, and the partitionings that follow them."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.grid import Grid
from tessera.plans.matrix import Matrix
from tessera.plans.storage import shuffled
from tessera.plans.vector import Vector


def block_owner(i: Column, n: int, parts: int) -> Column:
    return F.floor(i / -(-n // parts)).cast("int") if n else F.lit(0)


def block_local(i: Column, n: int, parts: int) -> Column:
    return (i % -(-n // parts)).cast("long") if n else F.lit(0).cast("long")


def cyclic_owner(i: Column, chunk: int, parts: int) -> Column:
    return (F.floor(i / chunk) % parts).cast("int")


def cyclic_local(i: Column, chunk: int, parts: int) -> Column:
    return (F.floor(i / (chunk * parts)) * chunk + i % chunk).cast("long")


def general_block_offsets(n: int, weights: list[float]) -> list[int]:
    """Ends of blocks in proportion to the weights, rounded to the nearest index."""
    total = sum(weights)
    return [int(w / total * n + 0.5) for w in accumulate(weights)]


def general_block_owner(i: Column, ends: list[int]) -> Column:
    """The first block whose end lies beyond i; one comparison a block."""
    owner = F.lit(len(ends) - 1)
    for p in range(len(ends) - 2, -1, -1):
        owner = F.when(i < ends[p], F.lit(p)).otherwise(owner)
    return owner.cast("int")


def grid_owner(i: Column, grid: Grid, procs: tuple[int, ...]) -> Column:
    """Blocks in each dimension over a grid of parts, row-major."""
    at = [F.floor(d / -(-n // p)).cast("long") for d, n, p in zip(grid.dims(i), grid.shape, procs)]
    return Grid(procs).position(at).cast("int")


def proc_grid(parts: int, shape: tuple[int, ...]) -> tuple[int, ...]:
    """The factorisation of parts whose blocks of the shape have the least surface."""
    best: tuple[float, tuple[int, ...]] | None = None

    def split(left: int, dims: int):
        if dims == 1:
            yield (left,)
            return
        for f in range(1, left + 1):
            if left % f == 0:
                for rest in split(left // f, dims - 1):
                    yield (f, *rest)

    for found in split(parts, len(shape)):
        sides = [n / p for n, p in zip(shape, found)]
        surface = 0.0
        for k in range(len(sides)):
            face = 1.0
            for x in sides[:k] + sides[k + 1 :]:
                face *= x
            surface += face
        if best is None or surface < best[0]:
            best = surface, found
    return best[1]


def redistribute(x: "Vector | Matrix", owner: Column, parts: int) -> DataFrame:
    """The rows of x with their owner, dealt so that rows of one owner are in one partition."""
    return x.df.withColumn("owner", owner).repartition(parts, "owner")


def by_lookup(x: "Vector | Matrix", owners: DataFrame) -> DataFrame:
    """Rows of x with the owner that a table (i, owner) gives."""
    return x.df.join(shuffled(owners.select("i", "owner"), x.n), "i")


def block_sizes(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("owner").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


def replicate(x: Vector, parts: int) -> DataFrame:
    """(owner, i, v): all rows of x with each of the owners; copies are made per row."""
    owners = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    return x.df.select(owners.alias("owner"), "i", "v")


def halo(matrix: Matrix, owner_of, parts: int) -> DataFrame:
    """(owner, j, source): the columns that each owner's rows need from other owners."""
    needed = matrix.df.select(owner_of(F.col("i")).alias("owner"), "j", owner_of(F.col("j")).alias("source"))
    return needed.filter("owner != source").distinct()


def edge_cut(matrix: Matrix, owners: DataFrame) -> DataFrame:
    """(cut, edges): how many edges of the matrix's graph have ends with different owners."""
    e = matrix.edges()
    a = owners.select(F.col("i"), F.col("owner").alias("a"))
    b = owners.select(F.col("i").alias("j"), F.col("owner").alias("b"))
    return e.join(a, "i").join(b, "j").agg(F.count_if(F.col("a") != F.col("b")).alias("cut"), F.count("*").alias("edges"))


#: How much larger than its share a part of a graph partitioning may be.
BALANCE = 1.05


def weighted_blocks(matrix: Matrix, weights: list[float], rounds: int = 8) -> DataFrame:
    """(i, owner): a graph partitioning by rows.

    Rows start in blocks in proportion to the weights. In each round a row goes to the owner that
    most of its neighbours have if that cuts fewer edges and the owner has room (a twentieth above
    its share); half the rows, by parity of a hash, may move per round. Size counts and moves are
    aggregates; a round is one written table. Of all rounds' partitionings, the blocks included,
    that with the fewest cut edges is returned, of those whose parts are within BALANCE of their
    shares (rounded up): it cuts no more edges than the blocks do.
    """
    from tessera.plans.storage import cut

    n, parts, total = matrix.n, len(weights), sum(weights)
    owners = matrix.df.sparkSession.range(n).select(F.col("id").alias("i"), general_block_owner(F.col("id"), general_block_offsets(n, weights)).alias("owner"))
    both = matrix.edges()
    both = cut(both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"))))
    best_cut, best_owners = None, None
    most = [math.ceil(BALANCE * n * w / total) for w in weights]
    for k in range(rounds + 1):
        owners = cut(owners)
        sizes = {r.owner: r.n for r in owners.groupBy("owner").agg(F.count("*").alias("n")).collect()}  # a row a part
        now = edge_cut(matrix, owners).first().cut
        if best_cut is None or (now < best_cut and all(sizes.get(p, 0) <= most[p] for p in range(parts))):
            best_cut, best_owners = now, owners
        if k == rounds:
            break
        room = F.create_map(*[x for p in range(parts) for x in (F.lit(p), F.lit(max(0, most[p] - sizes.get(p, 0))))])
        near = both.join(owners.select(F.col("i").alias("j"), F.col("owner").alias("o")), "j").groupBy("i", "o").agg(F.count("*").alias("c"))
        best = near.groupBy("i").agg(F.max_by("o", F.struct("c", -F.col("o"))).alias("best"), F.max("c").alias("gain"))
        mine = near.withColumnRenamed("o", "owner").withColumnRenamed("c", "stay")
        rows = owners.join(best, "i", "left").join(mine, ["i", "owner"], "left")
        share = F.element_at(room, F.col("best")) / F.lit(max(1.0, n / parts / 2))
        moves = (F.col("gain") > F.coalesce("stay", F.lit(0))) & (F.pmod(F.xxhash64("i"), F.lit(2)) == k % 2) & (F.pmod(F.xxhash64("i", F.lit(k)), F.lit(1000)) / 1000.0 < share)
        owners = rows.select("i", F.when(moves, F.col("best")).otherwise(F.col("owner")).alias("owner"))
    return best_owners


#: Owner functions by name: (index, number of indexes, parts) to an owner.
DISTRIBUTIONS: dict[str, Callable[[Column, int, int], Column]] = {
    "block": block_owner,
    "cyclic": lambda i, n, parts: cyclic_owner(i, 1, parts),
    "single": lambda i, n, parts: F.lit(0),
}


def register_distribution(name: str, owner: Callable[[Column, int, int], Column]) -> None:
    """Make a distribution of one's own known to distribute()."""
    DISTRIBUTIONS[name] = owner


def distribute(x: "Vector | Matrix", name: str, parts: int) -> DataFrame:
    """The rows of x dealt to the owners of a distribution by its name."""
    return redistribute(x, DISTRIBUTIONS[name](F.col("i"), x.n, parts).cast("int"), parts)


#: Partitionings of a square matrix's rows by name: (matrix, weights of the parts) to (i, owner).
PARTITIONINGS: dict[str, Callable[[Matrix, list[float]], DataFrame]] = {
    "block": lambda m, w: m.df.sparkSession.range(m.n).select(F.col("id").alias("i"), general_block_owner(F.col("id"), general_block_offsets(m.n, w)).alias("owner")),
    "cyclic": lambda m, w: m.df.sparkSession.range(m.n).select(F.col("id").alias("i"), cyclic_owner(F.col("id"), 1, len(w)).alias("owner")),
    "graph": weighted_blocks,
}


def partition(matrix: Matrix, weights: list[float], name: str = "graph") -> DataFrame:
    """(i, owner) of the rows, by the partitioning's name."""
    return PARTITIONINGS[name](matrix, weights)


def rectangular(matrix: Matrix, weights: list[float], name: str = "graph") -> tuple[DataFrame, DataFrame]:
    """Owners of rows and of columns of a rectangular matrix.

    Rows are partitioned as the graph of rows that share columns is; a column goes to the owner with
    most of its entries, of equals the smallest.
    """
    pattern = Matrix(matrix.df.select("i", "j", F.lit(1.0).alias("v")), matrix.n, matrix.m)
    rows = partition(pattern.matmul(pattern.transpose()), weights, name)
    shares = matrix.df.join(rows, "i").groupBy("j", "owner").agg(F.count("*").alias("n"))
    return rows, shares.groupBy("j").agg(F.max_by("owner", F.struct("n", -F.col("owner"))).alias("owner"))
