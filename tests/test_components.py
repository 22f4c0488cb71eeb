"""Components of dense graphs: a part of the edges first, then whatever that left apart."""

import random

from spandrel.operators import components as C


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_dense_graphs_contract_few_edges(spark, monkeypatch):
    """Dense heaps, bridges between some, nodes of one edge and loops; before, all edges went through every join of the first round, twice."""
    r = random.Random(3)
    edges = [(f"h{k}.{r.randrange(60)}", f"h{k}.{r.randrange(60)}") for k in range(6) for _ in range(1200)]
    edges += [("h0.1", "h1.1"), ("h2.5", "x"), ("x", "y"), ("lone1", "lone2"), ("z", "z")] + [(f"leaf{i}", f"h{i % 6}.0") for i in range(40)]
    seen, real = [], C._contracted
    monkeypatch.setattr(C, "LARGE", 1000)
    monkeypatch.setattr(C, "_contracted", lambda one: (seen.append(one.count()), real(one))[1])
    rows = C.connected_roots(spark.createDataFrame(edges, "u string, v string")).collect()
    got = {}
    for x in rows:
        got.setdefault(x["root"], set()).add(x["node"])
    assert len(rows) == len({x["node"] for x in rows})
    assert {frozenset(g) for g in got.values()} == plain(edges)
    assert len(seen) == 2 and sum(seen) < len(edges) / 3
