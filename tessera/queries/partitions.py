"""Distributions, redistribution and graph partitioning."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.plans import partition as part
from tessera.plans.grid import Grid
from tessera.plans.matrix import Matrix
from tessera.plans.multilevel import partition_graph
from tessera.plans.storage import cut, stored
from tessera.queries.inputs import Registry, Tables, vector_out

R = Registry()
T = Tables

R.add("r01_redistribute_block", lambda s, d: part.block_sizes(part.redistribute(T(s, d).x, part.block_owner(F.col("i"), T(s, d).x.n, 7), 7)), "SELECT CAST(i // CAST(ceil((SELECT max(o_orderkey) + 1 FROM orders) / 7) AS BIGINT) AS INTEGER) AS owner, count(*) AS n, min(i) AS first, max(i) AS last FROM x GROUP BY 1")
R.add("r01_redistribute_cyclic", lambda s, d: part.block_sizes(part.redistribute(T(s, d).x, part.cyclic_owner(F.col("i"), 3, 4), 4)), "SELECT CAST((i // 3) % 4 AS INTEGER) AS owner, count(*) AS n, min(i) AS first, max(i) AS last FROM x GROUP BY 1")
R.add("r01_redistribute_general_block", lambda s, d: part.block_sizes(part.redistribute(T(s, d).x, part.general_block_owner(F.col("i"), part.general_block_offsets(T(s, d).x.n, [1, 2, 1])), 3)), "SELECT CASE WHEN i < floor(n * 0.25 + 0.5) THEN 0 WHEN i < floor(n * 0.75 + 0.5) THEN 1 ELSE 2 END AS owner, count(*) AS n, min(i) AS first, max(i) AS last FROM x, (SELECT max(o_orderkey) + 1 AS n FROM orders) GROUP BY 1")
R.add("r01_redistribute_grid", lambda s, d: part.redistribute(T(s, d).known.concat(T(s, d).known).resize(48), part.grid_owner(F.col("i"), Grid((6, 8)), (2, 2)), 4).select("i", "owner"), "SELECT i, CAST((i // 8 // 3) * 2 + (i % 8) // 4 AS INTEGER) AS owner FROM range(48) r(i)")


@R.query("r02_redistribute_plan", "SELECT i, round(v, 4) AS v FROM x")
def _(s, d):
    """There and back by a stored plan."""
    x = T(s, d).x
    plan = stored(x.df.select("i", part.cyclic_owner(F.col("i"), 1, 5).alias("owner")), "plan")
    there = part.by_lookup(x, plan).repartition(5, "owner")
    return there.repartition(3, part.block_owner(F.col("i"), x.n, 3)).select("i", rounded("v", 4).alias("v"))


R.add("r03_redistribute_matrix", lambda s, d: part.redistribute(T(s, d).s, part.block_owner(F.col("i"), T(s, d).s.n, 4), 4).groupBy("owner").agg(F.count("*").alias("nnz"), rounded(F.sum("v"), 2).alias("v")), "SELECT CAST(s.i // CAST(ceil((SELECT max(p_partkey) + 1 FROM part) / 4) AS BIGINT) AS INTEGER) AS owner, count(*) AS nnz, round(sum(v), 2) AS v FROM s GROUP BY 1")


@R.query("r04_replicate", "SELECT CAST(k AS INTEGER) AS owner, i, round(v, 4) AS v FROM p, range(4) r(k)")
def _(s, d):
    """All of a vector with each of four owners."""
    return part.replicate(T(s, d).p, 4).select("owner", "i", rounded("v", 4).alias("v"))


R.add("r05_local_indexes", lambda s, d: T(s, d).x.df.select("i", part.cyclic_owner(F.col("i"), 3, 4).alias("owner"), part.cyclic_local(F.col("i"), 3, 4).alias("local"), part.block_local(F.col("i"), T(s, d).x.n, 4).alias("block_local")), "SELECT i, CAST((i // 3) % 4 AS INTEGER) AS owner, (i // 12) * 3 + i % 3 AS local, i % CAST(ceil((SELECT max(o_orderkey) + 1 FROM orders) / 4) AS BIGINT) AS block_local FROM x")
_BLOCK = "CAST({} // CAST(ceil((SELECT max(p_partkey) + 1 FROM part) / 4) AS BIGINT) AS INTEGER)"
_I, _J = _BLOCK.format("near.i"), _BLOCK.format("near.j")
R.add("r06_halo", lambda s, d: part.halo(T(s, d).near, lambda i: part.block_owner(i, T(s, d).size("part", "p_partkey"), 4), 4), f"SELECT DISTINCT {_I} AS owner, j, {_J} AS source FROM near WHERE {_I} <> {_J}")


def _blocks(s, d):
    n = T(s, d).size("part", "p_partkey")
    return s.range(n).select(F.col("id").alias("i"), part.block_owner(F.col("id"), n, 4).alias("owner"))


R.add("r07_partition_block_cut", lambda s, d: part.edge_cut(T(s, d).near, _blocks(s, d)), f"SELECT count(*) FILTER ({_I} <> {_J}) AS cut, count(*) AS edges FROM near WHERE i < j")


@R.query("r07_partition_graph", "SELECT count(*) AS n, 4::BIGINT AS parts, true AS no_worse, true AS balanced FROM part")
def _(s, d):
    """The graph of parts in four, by refinement: every row has an owner, no part is above 1.05 of its share, and no more edges are cut than by blocks."""
    m = T(s, d).near
    m = Matrix(stored(m.df, "near"), m.n, m.n)
    owners = part.partition(m, [1, 1, 1, 1])
    before, after = part.edge_cut(m, _blocks(s, d)).first().cut, part.edge_cut(m, owners).first().cut
    sizes = owners.groupBy("owner").agg(F.count("*").alias("n"))
    most = math.ceil(part.BALANCE * m.n / 4)
    return sizes.agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.lit(after <= before).alias("no_worse"), (F.max("n") <= most).alias("balanced"))


#: Four groups of parts by remainder: within each, parts are linked with the first, second and fifth one after (in a ring); between them, each fiftieth part with the next number.
_PLANTED = "(SELECT count(*) FROM part WHERE p_partkey % 50 = 0 AND p_partkey + 1 < (SELECT count(*) FROM part))"


@R.query("r07_partition_planted", f"SELECT {_PLANTED} AS cut, p_partkey % 4 AS member, count(*) AS n, 1::BIGINT AS owners FROM part GROUP BY p_partkey % 4")
def _(s, d):
    """A graph of parts with planted groups, none of them contiguous: the partitioning finds them, hence the planted cut.

    Links within groups weigh 4 and are not to be cut. Without that the planted cut is the least one of small tables
    only: it grows with the table, that of contiguous pieces of the groups doesn't.
    """
    n = T(s, d).size("part", "p_partkey")
    i = F.col("p_partkey").cast("long")
    inner = T(s, d).table("part").select(i.alias("i"), F.explode(F.array(*[F.lit(4 * k) for k in (1, 2, 5)])).alias("d")).select("i", F.pmod(F.col("i") + F.col("d"), F.lit(n)).alias("j"), F.lit(4.0).alias("v"))
    outer = T(s, d).table("part").filter((F.col("p_partkey") % 50 == 0) & (F.col("p_partkey") + 1 < n)).select(i.alias("i"), (i + 1).alias("j"), F.lit(1.0).alias("v"))
    graph = Matrix(cut(inner.unionByName(outer)), n, n)
    owners = cut(partition_graph(graph, [1.0] * 4, weighted=True, unbroken=4.0))
    crossing = part.edge_cut(graph, owners).select("cut")
    groups = owners.groupBy((F.col("i") % 4).cast("int").alias("member")).agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"))
    return groups.join(F.broadcast(crossing)).select("cut", "member", "n", "owners")


@R.query("r07_partition_rectangular", f"SELECT j, CAST(arg_max(o, (n, -o)) AS INTEGER) AS owner FROM (SELECT s.j, s.i // CAST(ceil((SELECT max(p_partkey) + 1 FROM part) / 4) AS BIGINT) AS o, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY j")
def _(s, d):
    """Parts by blocks; suppliers go where most of their parts are."""
    return part.rectangular(T(s, d).s, [1, 1, 1, 1], "block")[1]


R.add("r08_graph_edges", lambda s, d: T(s, d).near.edges(), "SELECT i, j FROM near WHERE i < j")
R.add("r09_all_to_all", lambda s, d: T(s, d).x.df.groupBy(part.block_owner(F.col("i"), T(s, d).x.n, 4).alias("source"), part.cyclic_owner(F.col("i"), 1, 4).alias("target")).agg(F.count("*").alias("n"), rounded(F.sum("v"), 2).alias("v")), "SELECT CAST(i // CAST(ceil((SELECT max(o_orderkey) + 1 FROM orders) / 4) AS BIGINT) AS INTEGER) AS source, CAST(i % 4 AS INTEGER) AS target, count(*) AS n, round(sum(v), 2) AS v FROM x GROUP BY 1, 2")
R.add("r10_processor_grid", lambda s, d: T(s, d).table("region").filter("r_regionkey = 0").select(F.lit(part.proc_grid(12, (60, 20))[0]).alias("p"), F.lit(part.proc_grid(12, (60, 20))[1]).alias("q")), "SELECT 6 AS p, 2 AS q FROM region WHERE r_regionkey = 0")


@R.query("f07_own_distribution", "SELECT CAST((i * 7) % 5 AS INTEGER) AS owner, count(*) AS n, min(i) AS first, max(i) AS last FROM x GROUP BY 1")
def _(s, d):
    """A distribution that is registered by its name, and rows dealt by it."""
    part.register_distribution("sevens", lambda i, n, parts: F.pmod(i * 7, F.lit(parts)))
    return part.block_sizes(part.distribute(T(s, d).x, "sevens", 5))
