import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spandrel.operators import analytics as A
from spandrel.operators.graph import Graph
from spandrel.plans.fixtures import plain_nodes
from spandrel.schema import EDGES, NODES
from spandrel.sources import export


def graph(spark, ids, edges, kind="calls"):
    nodes = plain_nodes(spark.createDataFrame([(i,) for i in ids], "id string"))
    return Graph.from_frames(nodes, spark.createDataFrame([(*e, kind)[:3] for e in edges], EDGES))


def test_first_node_wins_whole(spark):
    rows = [("a", "first", "class", "f", 1, False, None, 2), ("a", "second", "module", "g", 2, False, "d", 3), ("a", "late", "module", "g", 2, False, "d", 9)]
    n = spark.createDataFrame(rows, "id string, name string, kind string, file string, line long, is_external boolean, docstring string, seq long")
    got = Graph.from_frames(n, spark.createDataFrame([], EDGES)).nodes.collect()
    assert [(r["name"], r["docstring"]) for r in got] == [("first", None)]


def test_edges_are_distinct_by_kind_and_need_both_ends(spark):
    g = Graph.from_frames(plain_nodes(spark.createDataFrame([("a",), ("b",)], "id string")), spark.createDataFrame([("a", "b", "contains"), ("a", "b", "contains"), ("a", "b", "calls"), ("a", "x", "calls"), ("a", "a", "calls")], EDGES))
    assert sorted(map(tuple, g.edges.collect())) == [("a", "a", "calls"), ("a", "b", "calls"), ("a", "b", "contains")]
    assert g.has_node("a") and not g.has_node("x")


def test_literal_order_drops_edges_before_their_ends(spark):
    n = plain_nodes(spark.createDataFrame([("a",), ("b",)], "id string")).withColumn("seq", F.when(F.col("id") == "a", 0).otherwise(5))
    e = spark.createDataFrame([("a", "b", "contains", 3), ("a", "b", "calls", 7)], "source string, target string, kind string, seq int")
    assert [r["kind"] for r in Graph.from_frames(n, e, literal_order=True).edges.collect()] == ["calls"]


def test_round_trip_and_stats(spark, tmp_path):
    g = graph(spark, ["m", "c"], [("m", "c"), ("c", "m")])
    export.export_json(g, str(tmp_path / "g.json"))
    assert json.loads((tmp_path / "g.json").read_text())["stats"]["node_count"] == 2
    back = Graph.read_json(spark, str(tmp_path / "g.json"))
    assert back.nodes.count() == 2 and back.edges.count() == 2
    one = back.stats().first()
    assert (one["node_count"], one["edge_count"], one["function_count"]) == (2, 2, 2)


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    for df in (A.coupling(g), A.orphans(g), A.components(g), A.cycles(g), A.inheritance_depth(g), A.within_hops(g, "a", 2)):
        assert df.count() == 0
    assert A.analyze(g).summary().first()["component_count"] == 0


def test_cycle_orphan_coupling(spark):
    g = graph(spark, "abc", [("a", "b"), ("b", "a")])
    assert {r["id"] for r in A.cycle_nodes(g).collect()} == {"a", "b"}
    assert [r["id"] for r in A.orphans(g).collect()] == ["c"]
    assert all(0 <= r["coupling_score"] <= 1 for r in A.coupling(g).collect())
    assert graph(spark, "a", [("a", "a")]) and A.cycles(graph(spark, "a", [("a", "a")])).count() == 0


@pytest.mark.parametrize("edges, depth", [([], {"B": 0}), ([("C", "B")], {"C": 1, "B": 0}), ([("L", "M"), ("M", "B")], {"L": 2, "M": 1, "B": 0}), ([("x", "y"), ("y", "x"), ("z", "x")], {"x": 2, "y": 1, "z": 3}), ([("s", "s")], {"s": 1})])
def test_inheritance_depth(spark, edges, depth):
    ids = sorted({x for e in edges for x in e} | set(depth))
    got = {r["id"]: r["depth_of_inheritance"] for r in A.inheritance_depth(graph(spark, ids, edges, "inherits")).collect()}
    assert got == depth


def test_diff_of_self_is_empty_and_changes_show(spark):
    a, b = graph(spark, ["common", "removed"], [("common", "removed")]), graph(spark, ["common", "added"], [])
    assert all(df.count() == 0 for df in A.diff(a, a).values())
    d = A.diff(a, b)
    assert [r["id"] for r in d["added_nodes"].collect()] == ["added"] and [r["id"] for r in d["removed_nodes"].collect()] == ["removed"]
    assert d["removed_edges"].count() == 1 and d["added_edges"].count() == 0


def brute_components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_cycles(ids, edges):
    out = {i: {i} for i in ids}
    for _ in ids:
        for a, b in edges:
            out[a] |= out[b]
    return {i: min(j for j in ids if j in out[i] and i in out[j]) for i in ids if any(j != i and j in out[i] and i in out[j] for j in ids)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(r.randint(1, 14))]
    edges = sorted({(r.choice(ids), r.choice(ids)) for _ in range(r.randint(0, 18))})
    g = graph(spark, ids, edges)
    comps = {x["id"]: x["component_id"] for x in A.components(g).collect()}
    assert comps == brute_components(ids, edges)
    cyc = {x["id"]: x["cycle_id"] for x in A.cycles(g).collect()}
    assert cyc == brute_cycles(ids, edges)
    assert all(comps[i] == comps[c] for i, c in cyc.items())
    deg = A.degrees(g).agg(F.sum("in_degree"), F.sum("out_degree")).first()
    assert deg[0] == deg[1] == len(edges)
    near = [{x["id"] for x in A.within_hops(g, ids[0], k).collect()} for k in (1, 2)]
    assert near[0] <= near[1]


def rounds(monkeypatch):
    """Counts the checkpoints, of which every round has a fixed number."""
    from spandrel.operators import analytics

    n = [0]
    real = analytics.checkpoint

    def counted(df):
        n[0] += 1
        return real(df)

    monkeypatch.setattr(analytics, "checkpoint", counted)
    return n


def test_long_rings_and_chains(spark, monkeypatch):
    """10,000 nodes in a ring with a tail, and in a chain of inheritance with a shortcut: rounds as the logarithm."""
    n = rounds(monkeypatch)
    ids = [f"n{i:05d}" for i in range(10_000)]
    ring = [(a, b) for a, b in zip(ids[:9000], ids[1:9000] + ids[:1])] + [(ids[i], ids[i + 1]) for i in range(8999, 9003)]
    got = {r["id"]: r["cycle_id"] for r in A.cycles(graph(spark, ids, ring)).collect()}
    assert got == dict.fromkeys(ids[:9000], ids[0]) and n[0] < 250, n
    n[0] = 0
    chain = [(a, b) for a, b in zip(ids[1:], ids)] + [(ids[5000], ids[3]), (ids[9999], ids[2])]
    got = {r["id"]: r["depth_of_inheritance"] for r in A.inheritance_depth(graph(spark, ids, chain, "inherits")).collect()}
    assert got == {x: i for i, x in enumerate(ids)} and n[0] < 60, n


def plain_depth(ids, edges):
    up = {}
    for c, p in sorted(edges):
        up.setdefault(c, []).append(p)
    known = {}

    def acyclic(x, path):
        if x in path:
            return None
        got = [acyclic(p, path | {x}) for p in up.get(x, [])]
        return None if None in got else max((g + 1 for g in got), default=0)

    for i in ids:
        if (d := acyclic(i, frozenset())) is not None:
            known[i] = d
    return known


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_random_depths(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(r.randint(2, 16))]
    edges = sorted({(r.choice(ids), r.choice(ids)) if r.random() < 0.1 else tuple(sorted(r.sample(ids, 2), reverse=True)) for _ in range(r.randint(0, 22))})
    got = {x["id"]: x["depth_of_inheritance"] for x in A.inheritance_depth(graph(spark, ids, edges, "inherits")).collect()}
    assert set(got) == set(ids)
    for i, d in plain_depth(ids, edges).items():
        assert got[i] == d


def test_diff_groups_no_more_edges_a_task_than_counted(spark, monkeypatch):
    """Edges are dealt before they are grouped, in as many parts as their number asks for."""
    monkeypatch.setattr(A, "GROUP_ROWS", 10)
    old, new = [(f"n{i}", f"n{i + 1}") for i in range(60)], [(f"n{i}", f"n{i + 1}") for i in range(20, 90)]
    found = A.diff_summary(graph(spark, ids_of(old), old), graph(spark, ids_of(new), new))
    assert {r["change"]: r["n"] for r in found.collect()} == {"added_nodes": 30, "removed_nodes": 20, "added_edges": 30, "removed_edges": 20}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def ids_of(edges):
    return sorted({x for e in edges for x in e})
