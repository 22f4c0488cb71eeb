"""Cycles and depth on deep graphs: the same as plain searches, in few rounds, with nothing solved in one task."""

import random

import pytest
from test_graph import brute_cycles, graph

from spandrel.operators import analytics as A
from spandrel.operators import contraction as C
from spandrel.operators import tables


@pytest.fixture()
def tables_written(monkeypatch):
    """Counts the tables that are written, of which every round has three, and one more when it is taken back; nothing is small enough for one task."""
    n = [0]
    real = tables.Scratch.keep

    def keep(self, df):
        n[0] += 1
        return real(self, df)

    monkeypatch.setattr(tables.Scratch, "keep", keep)
    monkeypatch.setattr(C, "CORE", 0)
    return n


def ladder(k, both=False):
    rails = [(f"{s}{i:04d}", f"{s}{i + 1:04d}") for s in "ab" for i in range(k - 1)]
    return rails + [(f"a{i:04d}", f"b{i:04d}") for i in range(k)] + [(f"b{i:04d}", f"a{i:04d}") for i in range(k) if both]


def grid(m):
    return [(f"{i:03d}.{j:03d}", f"{i + a:03d}.{j + 1 - a:03d}") for i in range(m) for j in range(m) for a in (0, 1) if i + a < m and j + 1 - a < m]


def chain(k):
    return [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(k - 1)]


def ids(edges):
    return sorted({x for e in edges for x in e})


@pytest.mark.parametrize(("edges", "most"), [(chain(10_000), 150), (ladder(5_000), 200), (grid(30), 200)], ids=["chain", "ladder", "grid"])
def test_deep_graphs_without_cycles(spark, tables_written, edges, most):
    assert A.cycles(graph(spark, ids(edges), edges)).count() == 0
    assert 0 < tables_written[0] < most


def test_deep_graphs_with_cycles(spark, tables_written):
    """A ladder of rungs both ways, a ring with a tail, and a grid whose last corner leads back to its first."""
    ring = [(a.replace("n", "r"), b.replace("n", "r")) for a, b in chain(900)] + [("r00899", "r00500")]
    edges = ladder(300, both=True) + ring + grid(12) + [("011.011", "000.000")]
    got = {r["id"]: r["cycle_id"] for r in A.cycles(graph(spark, ids(edges), edges)).collect()}
    want = {f"{s}{i:04d}": f"a{i:04d}" for s in "ab" for i in range(300)} | {f"r{i:05d}": "r00500" for i in range(500, 900)} | {x: "000.000" for x in ids(grid(12))}
    assert got == want
    assert tables_written[0] < 250


def test_depth_of_a_ladder(spark, tables_written):
    edges = ladder(400)
    got = {r["id"]: r["depth_of_inheritance"] for r in A.inheritance_depth(graph(spark, ids(edges), edges, "inherits")).collect()}
    assert got == {f"{s}{i:04d}": 399 - i + (s == "a") for s in "ab" for i in range(400)}
    assert tables_written[0] < 300  # cycles are looked for first


def plain_guarded_depth(edges):
    """The walk over each component on its own, parents outside it being known."""
    up = {}
    for a, b in sorted(set(edges)):
        up.setdefault(a, []).append(b)
    nodes = ids(edges)
    scc = brute_cycles(nodes, edges)
    depth = {}

    def inside(x, path, c):
        if x in depth:
            return depth[x]
        if x in path:
            return 0
        best = max((inside(p, path | {x}, c) if scc.get(p) == c and c is not None or p == x else solve(p)) for p in up[x]) + 1 if x in up else 0
        depth[x] = best
        return best

    def solve(x):
        if x not in depth:
            c = scc.get(x)
            for y in [x] if c is None else [y for y in nodes if scc.get(y) == c]:
                inside(y, frozenset(), c)
        return depth[x]

    return {x: solve(x) for x in nodes}


@pytest.mark.parametrize(("core", "seed"), [(0, 0), (0, 2), (6, 1), (6, 3), (50_000, 2), (50_000, 3)])
def test_random_graphs(spark, monkeypatch, core, seed):
    monkeypatch.setattr(C, "CORE", core)
    monkeypatch.setattr(C, "WAYS", seed)
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(22)]
    edges = sorted({(r.choice(names), r.choice(names)) for _ in range((15, 24, 34, 70)[seed])})
    assert {x["id"]: x["cycle_id"] for x in A.cycles(graph(spark, names, edges)).collect()} == brute_cycles(names, edges)
    got = {x["id"]: x["depth_of_inheritance"] for x in A.inheritance_depth(graph(spark, ids(edges), edges, "inherits")).collect()}
    assert got == plain_guarded_depth(edges)


def test_dense_core_is_coloured(spark, tables_written):
    """Two complete graphs joined one way: no node has few ways through it."""
    names = [f"x{i:02d}" for i in range(12)], [f"y{i:02d}" for i in range(12)]
    edges = [(a, b) for part in names for a in part for b in part if a != b] + [(a, b) for a in names[0] for b in names[1]]
    got = {r["id"]: r["cycle_id"] for r in A.cycles(graph(spark, ids(edges), edges)).collect()}
    assert got == {x: f"{x[0]}00" for part in names for x in part}


def test_tables_go(spark):
    import os

    from spandrel.operators.components import checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("scratch-")}
    assert A.cycles(graph(spark, "abc", [("a", "b"), ("b", "a")])).count() == 2
    assert {f for f in os.listdir(folder) if f.startswith("scratch-")} == before


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    """With no table counted as small nothing is broadcast, however small its files look."""
    from spandrel.operators import components

    plans, real = [], tables.Scratch.keep

    def keep(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(self, df)

    monkeypatch.setattr(tables.Scratch, "keep", keep)
    monkeypatch.setattr(components, "SMALL", 0)
    monkeypatch.setattr(C, "CORE", 0)
    edges = chain(6) + [("n00003", "n00001"), ("n00004", "n00004")]
    depth = A.inheritance_depth(graph(spark, ids(edges), edges, "inherits"))
    plans.append(depth._jdf.queryExecution().executedPlan().toString())
    assert {x["id"]: x["depth_of_inheritance"] for x in depth.collect()} == plain_guarded_depth(edges)
    assert len(plans) > 9 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """Tables of few rows are not broadcast either: each would take a page of the driver's memory, some in every round."""
    plans, real = [], tables.Scratch.keep

    def keep(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(self, df)

    monkeypatch.setattr(tables.Scratch, "keep", keep)
    monkeypatch.setattr(C, "CORE", 0)
    core = [f"x{i:02d}" for i in range(8)]
    edges = chain(6) + [("n00003", "n00001"), ("n00004", "n00004"), ("n00002", core[0])] + [(a, b) for a in core for b in core if a != b]
    depth = A.inheritance_depth(graph(spark, ids(edges), edges, "inherits"))
    plans.append(depth._jdf.queryExecution().executedPlan().toString())
    assert {x["id"]: x["depth_of_inheritance"] for x in depth.collect()} == plain_guarded_depth(edges)
    assert sum("SortMergeJoin" in p for p in plans) > 9 and not [p for p in plans if "Broadcast" in p]
