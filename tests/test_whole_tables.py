"""The queries over all rows: their edges are those of the tables, and the ones without SQL agree with a plain search."""

from collections import Counter

from helpers import duck

from spandrel.plans import catalog
from spandrel.plans import fixtures as X


def test_every_row_takes_part(spark, data):
    assert not any(word in block for block in (X.CATALOG_EDGES, X.COPURCHASE, X.TRADE, X.SNAP_OLD, X.SNAP_NEW) for word in ("l_quantity", "l_discount", "r <="))
    bought = set(duck("select o_custkey, l_partkey from lineitem join orders on l_orderkey = o_orderkey").fetchall())
    assert {(r.source, r.target) for r in X.copurchase(spark, data).edges.collect()} == {(f"c{a}", f"p{b}") for a, b in bought}


def test_components(spark, data):
    edges = duck("select 'c' || o_custkey, 'p' || l_partkey from lineitem join orders on l_orderkey = o_orderkey").fetchall()
    beside = {f"c{k}": set() for (k,) in duck("select c_custkey from customer").fetchall()}
    for a, b in edges:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    name = {}
    for start in sorted(beside):
        todo = [] if start in name else [start]
        while todo:
            x = todo.pop()
            if x not in name:
                name[x] = start
                todo += beside[x]
    sizes = Counter(name.values())
    largest = min(sizes, key=lambda c: (-sizes[c], c))
    assert {r.id: r.component_id for r in catalog.QUERIES["components"](spark, data).collect()} == name
    assert {r.component_id: r.size for r in catalog.QUERIES["component_sizes"](spark, data).collect()} == sizes
    assert {r.id for r in catalog.QUERIES["component_nth"](spark, data).collect()} == {x for x, c in name.items() if c == largest}


def test_keyed_edges_are_the_catalogue_edges(spark, data, tmp_path):
    """Made distinct by keys or by text: the same rows; where a nation has no region, the text decides."""
    import os

    from pyspark.sql import functions as F

    from spandrel.plans import fixtures as X

    for placed in (True, False):
        folder = f"{tmp_path}/{placed}"
        os.mkdir(folder)
        for t in os.listdir(data):
            os.symlink(f"{data}/{t}", f"{folder}/{t}")
        if not placed:
            os.remove(f"{folder}/nation.parquet")
            nation = spark.read.parquet(f"{data}/nation.parquet")
            nation.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey"))).write.parquet(f"{folder}/nation.parquet")
        plain, keyed = X.sql(spark, folder, X.CATALOG_EDGES), X.catalog(spark, folder).edges
        assert plain.exceptAll(keyed).isEmpty() and keyed.exceptAll(plain).isEmpty() and keyed.count() == plain.count()
