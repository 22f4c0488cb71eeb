"""Stored graphs: answers as those of the plain graph, from few files and without shuffles."""

import random

import pytest

from spandrel.operators import analytics as A
from spandrel.operators import layout
from spandrel.operators import views as V
from spandrel.operators.graph import Graph
from spandrel.schema import EDGES, NODES

BUCKETS = 16


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(5)
    nodes = [(f"n{i}", f"name{i}", "class", f"f{i % 7}.py", i, False, None if i % 3 else f"doc {i}") for i in range(400)]
    edges = {(f"n{rnd.randrange(300)}", f"n{rnd.randrange(300)}", rnd.choice(["calls", "imports"])) for _ in range(900)}
    edges |= {("n7", f"n{i}", "calls") for i in range(250)} | {(f"n{i}", "n8", "calls") for i in range(250)} | {("n301", "n302", "calls"), ("n302", "n303", "calls")}
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(sorted(edges), EDGES))


@pytest.fixture(scope="module", params=[10_000, 100])
def stored(request, graph):
    """Without hubs, and with two of them."""
    return layout.Layout.write(graph, buckets=BUCKETS, hub_rows=request.param)


def rows(df, *columns):
    columns = columns or sorted(df.columns)
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_answers(graph, stored):
    assert rows(stored.degrees()) == rows(A.degrees(graph))
    assert rows(stored.edges_with_endpoints()) == rows(graph.edges_with_endpoints())
    assert rows(stored.graph().edges) == rows(graph.edges) and rows(stored.graph().nodes) == rows(graph.nodes)
    for id_ in ("n7", "n8", "n50", "n399", "nowhere"):
        plain = V.node_detail(graph, id_)
        for part, df in stored.detail(id_).items():
            assert rows(df) == rows(plain[part].select(*df.columns)), (id_, part)


@pytest.mark.parametrize("few", [0, 1000])
def test_hops(graph, stored, few, monkeypatch):
    monkeypatch.setattr(layout, "FEW", few)
    for start, depth in (("n301", 1), ("n301", 5), ("n12", 2), ("n399", 3), ("nowhere", 2)):
        assert rows(stored.within_hops(start, depth)) == rows(A.within_hops(graph, start, depth)), (start, depth)


def test_hubs_lie_apart(stored):
    bucketed, hubs = stored._parts("outgoing")
    split = {r["source"] for r in hubs.select("source").distinct().collect()}
    assert split in (set(), {"n7"}) and not split & {r["source"] for r in bucketed.select("source").distinct().collect()}


@pytest.fixture
def shown(spark):
    """Spark prunes buckets in any scan, but shows them only where it isn't free to merge them."""
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_look_ups_read_one_bucket(stored, shown):
    assert f"SelectedBucketsCount: 1 out of {BUCKETS}" in plan(stored.node("n50"))
    for table in ("outgoing", "incoming"):
        text = plan(stored.edges_at(table, "n50"))
        assert f"SelectedBucketsCount: 1 out of {BUCKETS}" in text and "Exchange" not in text and "PushedFilters" in text


def test_whole_tables_without_shuffle(spark, stored):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        for df in (stored.degrees(), stored.edges_with_endpoints()):
            exchanges = [x for x in plan(df).split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]
            scans = [x for x in exchanges if "source" not in x and "target" not in x]
            assert not scans and len(exchanges) <= 2, exchanges  # those of the hubs' counts
    finally:
        spark.conf.set(key, before)


def test_written_and_opened_again(spark, graph, tmp_path, shown):
    folder = f"file://{tmp_path}/kept"
    layout.Layout.write(graph, folder, buckets=4).close()
    again = layout.Layout.open(spark, folder)
    assert again.buckets == 4 and rows(again.degrees()) == rows(A.degrees(graph))
    assert "SelectedBucketsCount: 1 out of 4" in plan(again.node("n1"))


def test_empty(spark):
    none = layout.Layout.write(Graph.empty(spark))
    assert none.degrees().count() == 0 and none.edges_with_endpoints().count() == 0 and none.within_hops("x", 3).count() == 0 and none.detail("x")["incoming"].count() == 0


def test_edges_move_three_times(spark, graph, monkeypatch):
    """To the rows of their sources, with these to their targets, and with the rows of their targets to their sources; nodes move once."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, real = {}, DataFrameWriter.saveAsTable

    def save(self, name, *more, **options):
        plans[name.split("_")[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return real(self, name, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", save)
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        layout.Layout.write(graph, buckets=BUCKETS)
    finally:
        spark.conf.set(key, before)
    assert {t: p.count("Exchange hashpartitioning") for t, p in plans.items()} == {"nodes": 1, "incoming": 2, "outgoing": 1}


def test_hubs_at_both_ends_and_ids_twice(spark):
    """Hubs as sources and targets at once, edges without a node, and a node that is there twice: as from the plain graph."""
    nodes = [(f"n{i}", f"name{i}", "class", "f.py", i, False, None) for i in range(40)]
    edges = [("n1", f"n{i}", "calls") for i in range(60)] + [(f"n{i}", "n1", "calls") for i in range(60)] + [(f"n{i}", f"n{i + 1}", "uses_type") for i in range(38)]
    for more in ([], [("n2", "other", "class", "g.py", 1, False, None)]):
        g = Graph(spark.createDataFrame(nodes + more, NODES), spark.createDataFrame(edges, EDGES))
        kept = layout.Layout.write(g, buckets=4, hub_rows=30)
        assert {r["target"] for r in kept._parts("incoming")[1].collect()} == {"n1"} == {r["source"] for r in kept._parts("outgoing")[1].collect()}
        assert rows(kept.edges_with_endpoints()) == rows(g.edges_with_endpoints())
        for end, table, other in (("source", "outgoing", "target"), ("target", "incoming", "source")):
            ids = g.nodes.select("id").distinct()
            want = g.edges.join(ids.withColumnRenamed("id", end), end).join(layout._row_of(g.nodes, other), other)
            got = kept._parts(table)
            assert rows(got[0].unionByName(got[1])) == rows(want)
