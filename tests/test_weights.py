"""Weights and treemaps of containment forests against plain recursion."""

import random

import pytest

from spandrel.operators import tables
from spandrel.operators import views as V
from spandrel.plans import fixtures as X


def forest(spark, rows):
    return spark.createDataFrame([(p, c, f"name{c}", False) for p, c in rows], "parent string, child string, name string, is_virtual boolean")


def plain_weights(rows):
    """None for what is on a cycle or holds one."""
    kids, ids = {}, {c for _, c in rows}
    for p, c in set(rows):
        if p is not None:
            kids.setdefault(p, []).append(c)
    known = {}
    open_ = set(ids)
    while fresh := {x for x in open_ if all(k in known for k in kids.get(x, []))}:
        for x in fresh:
            n = len(f"name{x}")
            if x in kids:
                known[x] = max(sum(known[k] for k in kids[x]), max(72, n * 9 + 24) * 54 / 2000)
            else:
                known[x] = max(1.0, max(72, n * 8 + 24) ** 2 / 2000)
        open_ -= fresh
    return known


def check(spark, rows):
    got = {r["id"]: r["weight"] for r in V.subtree_weights(forest(spark, rows)).collect()}
    assert got == pytest.approx(plain_weights(rows))


@pytest.mark.parametrize("seed", [0, 1])
def test_random_forests(spark, seed):
    """Chains, bushes, a child of two parents, and a cycle with what holds it."""
    r = random.Random(seed)
    rows = [(None, "n0")] + [(f"n{max(0, i - r.choice([1, 1, 1, 5, 30]))}", f"n{i}") for i in range(1, 80)] + [("n3", "n60"), ("n5", "x1"), ("x1", "x2"), ("x2", "x1"), ("x2", "x3")]
    check(spark, rows)


def test_deep_containment_in_few_rounds(spark, monkeypatch):
    n, real = [0], tables.Scratch.keep
    monkeypatch.setattr(tables.Scratch, "keep", lambda self, df: (n.__setitem__(0, n[0] + 1), real(self, df))[1])
    rows = [(None, "n00000")] + [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(1499)] + [(f"n{i:05d}", f"leaf{i}") for i in range(0, 1500, 7)]
    check(spark, rows)
    assert n[0] < 190


def test_unions_do_not_multiply(spark, data):
    """Nodes and edges that are unions are read once each; before, their joins ran branch by branch, in one stage of up to 1,000 operators."""
    ran = []
    real = tables.Scratch.keep

    def keep(self, df):
        ran.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return real(self, df)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables.Scratch, "keep", keep)
        shape = V.structure(X.catalog(spark, data), folders=False)
    assert shape._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert ran and max(ran) <= 4
    assert shape.count() == X.catalog(spark, data).nodes.count()
