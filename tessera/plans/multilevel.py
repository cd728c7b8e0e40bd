"""Graph partitioning on several levels: matched vertices become one, the smallest graph is cut, and the cut is refined on the way back.

Vertices propose to the neighbour of the heaviest edge; mutual proposals are matched, a few rounds a
level. What is left when no more than COARSEST vertices are is bounded, so it is partitioned in the
driver, by growing parts from several seeds and moving vertices one by one. On each finer level
vertices move to the part that most of their edges go to, where it has room, in rounds of aggregates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.matrix import Matrix
from tessera.plans.storage import cut

c = F.col
#: Vertices of the graph that is cut in the driver, which holds a square of them.
COARSEST = 400
#: How much larger than its share a part may be.
BALANCE = 1.05
MATCHING_ROUNDS, REFINING_ROUNDS, SEEDS = 4, 6, 24


def graph(matrix: Matrix, weighted: bool = False) -> DataFrame:
    """(i, j, w), each edge both ways: 1, or with weights the absolute values of both entries."""
    rows = matrix.df.filter("i != j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.abs("v").alias("w"))
    once = rows.groupBy("i", "j").agg((F.sum("w") if weighted else F.lit(1.0)).alias("w"))
    return once.unionByName(once.select(c("j").alias("i"), c("i").alias("j"), "w"))


def _pairs(edges: DataFrame, vertices: DataFrame, heaviest: float) -> DataFrame:
    """(i, to) for all vertices (i, w): matched ones go to the smaller of both."""
    free, found = vertices, []
    for k in range(MATCHING_ROUNDS):
        other = free.select(c("i").alias("j"), c("w").alias("wj"))
        open_ = edges.join(free.select("i", c("w").alias("wi")), "i").join(other, "j").filter(c("wi") + c("wj") <= heaviest)
        tie = F.xxhash64(F.least("i", "j"), F.greatest("i", "j"), F.lit(k))
        asked = cut(open_.groupBy("i").agg(F.max_by("j", F.struct("w", tie)).alias("j")))
        back = asked.select(c("j").alias("i"), c("i").alias("j"))
        both = cut(asked.join(back, ["i", "j"]).filter("i < j"))
        if both.isEmpty():
            break
        found.append(both)
        gone = both.select("i").unionByName(both.select(c("j").alias("i")))
        free = cut(free.join(gone, "i", "left_anti"))
    to = vertices.select("i", c("i").alias("to")) if not found else free.select("i", c("i").alias("to"))
    for both in found:
        to = to.unionByName(both.select("i", c("i").alias("to"))).unionByName(both.select(c("j").alias("i"), c("i").alias("to")))
    return cut(to)


def _shrunk(edges: DataFrame, vertices: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends = edges.join(to.withColumnRenamed("to", "a"), "i").join(to.select(c("i").alias("j"), c("to").alias("b")), "j").filter("a != b")
    fewer = ends.groupBy(c("a").alias("i"), c("b").alias("j")).agg(F.sum("w").alias("w"))
    return cut(fewer), cut(vertices.join(to, "i").groupBy(c("to").alias("i")).agg(F.sum("w").alias("w")))


def components(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """(i, to): the smallest vertex that links (i, j), each both ways, lead to; by rounds of large and small stars."""
    pairs, seen = cut(links.filter("i > j").select("i", "j")), None
    while True:
        both = pairs.unionByName(pairs.select(c("j").alias("i"), c("i").alias("j")))
        least = both.groupBy("i").agg(F.least(F.min("j"), c("i")).alias("m"))
        large = both.join(least, "i").filter("j > i").select(c("j").alias("i"), c("m").alias("j")).distinct()
        least = large.groupBy("i").agg(F.min("j").alias("m"))
        small = large.join(least, "i").select(F.explode(F.array(F.struct("i", c("m").alias("j")), F.struct(c("j").alias("i"), c("m").alias("j")))).alias("e")).select("e.i", "e.j")
        pairs = cut(small.filter("i != j").distinct())
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("i", "j"))).first()
        if now == seen:
            return cut(vertices.join(pairs.withColumnRenamed("j", "to"), "i", "left").select("i", F.coalesce("to", "i").alias("to")))
        seen = now


def _unbroken(edges: DataFrame, vertices: DataFrame, weight: float, most: float) -> DataFrame:
    """(i, to): vertices that edges of this weight or more lead to become one, unless they are heavier than most together."""
    to = components(edges.filter(c("w") >= weight), vertices)
    size = to.join(vertices, "i").groupBy("to").agg(F.sum("w").alias("w"))
    return cut(to.join(size.filter(c("w") > most).select("to", F.lit(True).alias("over")), "to", "left").select("i", F.when(c("over"), c("i")).otherwise(c("to")).alias("to")))


def _one_by_one(adjacent: np.ndarray, weight: np.ndarray, owner: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Moves of single vertices, the best one first, while they cut less or make a part fit."""
    k = len(most)
    near = np.stack([adjacent[:, owner == p].sum(axis=1) for p in range(k)], axis=1)
    size = np.bincount(owner, weight, k)
    for _ in range(4 * len(owner)):
        gain = near - near[np.arange(len(owner)), owner][:, None]
        fits = size[None, :] + weight[:, None] <= most[None, :]
        fits[np.arange(len(owner)), owner] = False
        over = size[owner] > most[owner]
        worth = np.where(fits & (over[:, None] | (gain > 0)), gain + 1e9 * over[:, None], -np.inf)
        v, p = np.unravel_index(int(np.argmax(worth)), worth.shape)
        if not np.isfinite(worth[v, p]):
            break
        near[:, owner[v]] -= adjacent[:, v]
        near[:, p] += adjacent[:, v]
        size[owner[v]] -= weight[v]
        size[p] += weight[v]
        owner[v] = p
    return owner


def cut_small(adjacent: np.ndarray, weight: np.ndarray, shares: np.ndarray, seeds: int = SEEDS) -> np.ndarray:
    """Owners of the vertices of a small graph: the best of partitionings grown from several seeds."""
    n, total = len(weight), weight.sum()
    most = np.maximum(BALANCE * shares * total, shares * total + weight.max() / 2)
    rng, best = np.random.default_rng(1), None
    for _ in range(seeds):
        owner = np.full(n, len(shares) - 1)
        open_ = np.ones(n, bool)
        for p in range(len(shares) - 1):
            near, held = rng.random(n) * 1e-9, 0.0
            while held < shares[p] * total - weight.min() / 2 and open_.any():
                v = int(np.argmax(np.where(open_, near, -1)))
                if held and held + weight[v] > most[p]:
                    break
                owner[v], open_[v], held = p, False, held + weight[v]
                near = near + adjacent[v]
        owner = _one_by_one(adjacent, weight, owner, most)
        size = np.bincount(owner, weight, len(shares))
        worth = (max(0.0, (size - most).max()), adjacent[owner[:, None] != owner[None, :]].sum())
        if best is None or worth < best[0]:
            best = (worth, owner.copy())
    return best[1]


def _refined(edges: DataFrame, vertices: DataFrame, owners: DataFrame, most: list[float], rounds: int) -> DataFrame:
    """Owners (i, owner) after rounds of moves; the best ones that fit are returned."""
    held, best = cut(owners), None
    for k in range(rounds + 1):
        size = {r.owner: r.w for r in vertices.join(held, "i").groupBy("owner").agg(F.sum("w").alias("w")).collect()}  # a row a part
        near = cut(edges.join(held.select(c("i").alias("j"), c("owner").alias("o")), "j").groupBy("i", "o").agg(F.sum("w").alias("w")))
        here = near.join(held, "i")
        crossing = here.filter("o != owner").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first().w
        worth = (max(0.0, *(size.get(p, 0.0) - m for p, m in enumerate(most))), crossing)
        if best is None or worth < best[0]:
            best = (worth, held)
        if k == rounds:
            break
        free = [max(0.0, m - size.get(p, 0.0)) for p, m in enumerate(most)]
        over = [max(0.0, size.get(p, 0.0) - m) for p, m in enumerate(most)]
        stay = here.filter("o = owner").select("i", c("w").alias("stay"))
        away = here.filter("o != owner").filter(F.element_at(F.array(*map(F.lit, free)), (c("o") + 1).cast("int")) > 0)
        to = away.groupBy("i").agg(F.max_by("o", F.struct("w", -c("o"))).alias("to"), F.max("w").alias("gain"))
        moves = to.join(stay, "i", "left").join(held, "i").join(vertices, "i").withColumn("gain", c("gain") - F.coalesce("stay", F.lit(0.0)))
        heavy = F.element_at(F.array(*map(F.lit, over)), (c("owner") + 1).cast("int")) > 0
        moves = cut(moves.filter((c("gain") > 0) | heavy).filter(F.pmod(F.xxhash64("i"), F.lit(2)) == k % 2))
        asked = {(r.to, r.up): r.w for r in moves.groupBy("to", (c("gain") > 0).alias("up")).agg(F.sum("w").alias("w")).collect()}
        share = {key: min(1.0, free[key[0]] / w) if key[1] else min(1.0, free[key[0]] / w, sum(over) / w) for key, w in asked.items()}
        if not share:
            continue
        chance = F.coalesce(*[F.when((c("to") == to_) & ((c("gain") > 0) == up), F.lit(s)) for (to_, up), s in share.items()])
        taken = moves.filter(F.pmod(F.xxhash64("i", F.lit(k)), F.lit(1 << 20)) < chance * (1 << 20)).select("i", "to")
        held = cut(held.join(taken, "i", "left").select("i", F.coalesce("to", "owner").alias("owner")))
    return best[1]


def partition_graph(matrix: Matrix, weights: list[float], vertex_weights: DataFrame | None = None, weighted: bool = False, coarsest: int = COARSEST, rounds: int = REFINING_ROUNDS, unbroken: float | None = None) -> DataFrame:
    """(i, owner): rows of a square matrix in parts of sizes in proportion to weights, with few edges of its graph between them.

    vertex_weights (i, w) are the rows' own weights (1 if none are given), weighted takes those of
    the edges from the entries. Parts stay within BALANCE of their shares, or half a vertex. Rows
    without edges fill the parts by their numbers' order. Edges of the weight unbroken or more are
    not cut, even where that makes the cut greater: what they link is one vertex (half of which a
    part may then be beyond its share), unless it is more than the largest part may hold.
    """
    spark, n = matrix.df.sparkSession, matrix.n
    shares = np.array(weights, float) / sum(weights)
    vertices = spark.range(n).select(c("id").alias("i"))
    vertices = cut(vertices.withColumn("w", F.lit(1.0)) if vertex_weights is None else vertices.join(vertex_weights.select("i", c("w").cast("double")), "i", "left").fillna(1.0, ["w"]))
    levels, edges, size, whole = [], cut(graph(matrix, weighted)), n, None
    total, heaviest = vertices.agg(F.sum("w"), F.max("w")).first()
    limits = lambda heaviest: [max(math.ceil(BALANCE * s * total), s * total + heaviest / 2) for s in shares]
    if unbroken is not None:
        whole = _unbroken(edges, vertices, unbroken, max(limits(heaviest)))
        edges, vertices = _shrunk(edges, vertices, whole)
        size, heaviest = vertices.agg(F.count("*"), F.max("w")).first()
    most = limits(heaviest)
    while size > coarsest:
        to = _pairs(edges, vertices, max(2 * heaviest, 3 * total / coarsest))
        levels.append((edges, vertices, to))
        edges, vertices = _shrunk(edges, vertices, to)
        before, size = size, vertices.count()
        if size > 0.95 * before:
            break
    if size <= 4 * coarsest:
        rows = vertices.orderBy("i").collect()
        place = {r.i: k for k, r in enumerate(rows)}
        adjacent = np.zeros((size, size))
        for r in edges.collect():
            adjacent[place[r.i], place[r.j]] = r.w
        found = cut_small(adjacent, np.array([r.w for r in rows]), shares)
        owners = spark.createDataFrame([(r.i, int(found[k])) for k, r in enumerate(rows)], "i long, owner int")
    else:  # few vertices have edges: their order decides, and moves mend it
        bounds = [int(x) for x in np.round(np.cumsum(shares) * n)]
        owners = vertices.select("i", F.coalesce(*[F.when(c("i") < b, F.lit(p)) for p, b in enumerate(bounds)], F.lit(len(bounds) - 1)).alias("owner"))
    owners = _refined(edges, vertices, owners, most, rounds)
    for edges, vertices, to in reversed(levels):
        owners = _refined(edges, vertices, to.join(owners.select(c("i").alias("to"), "owner"), "to").select("i", "owner"), most, rounds)
    if whole is not None:
        owners = whole.join(owners.select(c("i").alias("to"), "owner"), "to").select("i", "owner")
    return owners
