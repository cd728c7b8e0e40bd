"""Multilevel methods: graph partitioning and multigrid."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators.multigrid import aggregates, amg, hierarchy, independent_set, multigrid, strong_links
from tessera.operators.solvers import cg, iterations, residual_below
from tessera.plans.grid import Grid, Stencil, stencil_matrix
from tessera.plans.matrix import Matrix
from tessera.plans.multilevel import cut_small, partition_graph
from tessera.plans.partition import edge_cut
from tessera.plans.storage import cut
from tessera.plans.vector import Vector


def planted(spark, groups, size, seed=0):
    """Dense groups with few links between them, numbered at random: (matrix, group of each row, links between)."""
    rng = np.random.default_rng(seed)
    n = groups * size
    place = rng.permutation(n)
    edges = set()
    for g in range(groups):
        for a in range(size):
            for b in rng.choice(size, 6, replace=False):
                if a != b:
                    edges.add((min(a, int(b)) + g * size, max(a, int(b)) + g * size))
    between = set()
    while len(between) < 2 * groups:
        a, b = sorted(rng.integers(0, n, 2).tolist())
        if a // size != b // size:
            between.add((a, b))
    rows = [(int(place[a]), int(place[b]), 1.0) for a, b in edges | between]
    member = np.empty(n, int)
    member[place] = np.arange(n) // size
    return Matrix(spark.createDataFrame(rows, "i long, j long, v double"), n, n), member, len(between)


def test_planted_groups_are_found(spark):
    a, member, between = planted(spark, 3, 50)
    owners = partition_graph(a, [1.0, 1, 1], coarsest=60)
    found = {r.i: r.owner for r in owners.collect()}
    assert sorted(found) == list(range(a.n)) and edge_cut(a, owners).first().cut == between
    assert len({(member[i], o) for i, o in found.items()}) == 3


def test_parts_have_their_weights(spark):
    a = Matrix(cut(stencil_matrix(spark, Grid((20, 20)), Stencil.laplace(2, 5)).df), 400, 400)
    owners = cut(partition_graph(a, [3.0, 2, 1], coarsest=150))
    size = {r.owner: r["count"] for r in owners.groupBy("owner").count().collect()}
    assert all(size[p] <= 1.06 * 400 * w / 6 for p, w in enumerate((3, 2, 1))) and sum(size.values()) == 400
    assert edge_cut(a, owners).first().cut <= 75
    heavy = spark.range(400).selectExpr("id AS i", "CASE WHEN id < 20 THEN 20D ELSE 1D END AS w")
    owners = partition_graph(a, [1.0, 1], vertex_weights=heavy, coarsest=250).join(heavy, "i")
    halves = [r.w for r in owners.groupBy("owner").agg({"w": "sum"}).toDF("owner", "w").collect()]
    assert max(halves) <= 1.05 * sum(halves) / 2 + 10


def test_rows_without_edges_are_dealt(spark):
    a = Matrix(spark.createDataFrame([(0, 1, 1.0)], "i long, j long, v double"), 1000, 1000)
    owners = partition_graph(a, [1.0, 1.0], coarsest=50)
    size = {r.owner: r["count"] for r in owners.groupBy("owner").count().collect()}
    assert sum(size.values()) == 1000 and max(size.values()) <= 525


def test_small_graphs_are_cut_at_their_bridges():
    adjacent = np.zeros((12, 12))
    for g in (range(0, 6), range(6, 12)):
        adjacent[np.ix_(g, g)] = 1 - np.eye(6)
    adjacent[5, 6] = adjacent[6, 5] = 1
    owner = cut_small(adjacent, np.ones(12), np.array([0.5, 0.5]))
    assert len(set(owner[:6])) == len(set(owner[6:])) == 1 and owner[0] != owner[6]


def renumbered(spark, k):
    n = k * k
    rows = stencil_matrix(spark, Grid((k, k)), Stencil.laplace(2, 5)).df.selectExpr(f"(i * 7919) % {n} AS i", f"(j * 7919) % {n} AS j", "v")
    return Matrix(cut(rows), n, n)


def test_independent_sets_and_aggregates(spark):
    a = renumbered(spark, 15)
    links = cut(strong_links(a))
    near = np.zeros((225, 225), bool)
    for r in links.collect():
        near[r.i, r.j] = True
    two = near | (near @ near)
    chosen = [r.i for r in independent_set(links, 225).collect()]
    assert not (two[np.ix_(chosen, chosen)] & ~np.eye(len(chosen), dtype=bool)).any(), "no two are within two links"
    assert all(two[i, chosen].any() or i in chosen for i in range(225)), "and none can be added"
    groups, k = aggregates(links, 225)
    rows = groups.collect()
    assert sorted(r.i for r in rows) == list(range(225)) and {r.k for r in rows} == set(range(k)) and k == len(chosen)


def test_steps_of_multigrid_stay_few_as_systems_grow(spark):
    steps = []
    for k in (12, 24):
        a = renumbered(spark, k)
        x = Vector.by_function(spark, a.n, lambda i: i % 3 + 1.0)
        b = Vector(cut(a.times(x).df), a.n)
        h = hierarchy(a, coarsest=30)
        found = cg(a, b, stop=residual_below(1e-8, relative=True) | iterations(40), preconditioner=multigrid(h))
        steps.append(found.steps)
        assert found.x.max_diff_norm(x).first()[0] < 1e-5 and h.sizes[-1] <= 30
    assert steps[1] <= steps[0] + 4 and steps[1] <= 15, steps
    b = Vector(cut(a.times(Vector.fill(spark, a.n, 1.0)).df), a.n)
    assert amg(a, b, stop=residual_below(1e-4, relative=True) | iterations(40), coarsest=30, alone=True).steps < 40
