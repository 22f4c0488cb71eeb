"""Sort-means against comparison of every vector with every centroid, in Python's integers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException

from spandrel.llm import sort_means as sm


def plain(vectors, dim, scale, k, rounds, seed="1:"):
    kept = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in vectors if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))].append(v)
        for c, g in groups.items():
            centroids[c] = tuple(sum(x) // len(g) for x in zip(*g, strict=True))
    rows = []
    for i, v in kept:
        c = min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
        rows.append((i, c, far(v, centroids[c]), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))
    each = Counter()
    for _, c, d, _ in rows:
        each[c] += d
    return Counter((i, c, d, each[c], sum(each.values()), h) for i, c, d, h in rows)


def rows_of(n, dim, r):
    spots = r.normal(0, 4, (5, dim))
    return [(i, [float(c) for c in spots[i % 5] + r.normal(0, 0.2, dim)]) for i in range(n)]


@pytest.fixture(scope="module")
def vectors():
    rows = rows_of(400, 6, np.random.default_rng(3))
    ties = [(1000 + i, [float(i % 3 - 1)] * 6) for i in range(30)]
    odd = [(2000, None), (2001, [1.0] * 5), (2002, [1.0] * 7), (2003, [1.0] * 5 + [None]), (2004, [float("nan")] * 6), (2005, [float("inf")] + [0.0] * 5), (2006, [])]
    return [*rows, *ties, *odd, rows[3], rows[3], (None, [0.5] * 6), (None, [-0.5] * 6), (7, [9.0] * 6)]


def table(spark, rows, n=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, X long").repartition(n)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (5, 1), (1, 2), (1000, 2)])
def test_against_all_comparisons(spark, vectors, k, rounds):
    got = sm.report(table(spark, vectors), dim=6, k=k, rounds=rounds)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == plain(vectors, 6, 64, k, rounds)


def test_scan_stops_early(spark, vectors):
    """Where vectors lie in heaps, most centroids are never looked at, and rows beyond one stretch of a batch come right."""
    rows = rows_of(20_000, 6, np.random.default_rng(4))
    x = np.floor(np.array([v for _, v in rows]) * 64).astype(np.int64)
    centroids = x[[*range(5), *range(5, 16)]]
    cluster, distance, work = sm.assign(x, np.zeros(len(x), np.int32), centroids)
    far = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (cluster == far.argmin(1)).all() and (distance == far.min(1)).all()
    _, _, again = sm.assign(x, cluster, centroids)
    assert again.mean() < 8 < 16 and (sm.assign(x, cluster, centroids)[0] == cluster).all()
    out = sm.report(table(spark, rows, 1), dim=6)
    assert out.selectExpr("avg(compared)").first()[0] < 8 and out.count() == len(rows)


def test_ties_go_to_the_smaller_number():
    centroids = np.array([[4], [0], [8], [0]])
    x = np.array([[2], [6], [0], [4], [2]])
    for before in range(4):
        assert sm.assign(x, np.full(5, before, np.int32), centroids)[0].tolist() == [0, 0, 1, 0, 0]


def test_nothing_and_too_large(spark):
    empty = table(spark, [(1, None)])
    assert sm.report(empty, dim=6).collect() == []
    with pytest.raises(PySparkException):
        sm.report(table(spark, [(1, [1e12] * 6)]), dim=6).collect()


def test_oracle(spark, data):
    import duckdb

    duckdb.sql(f"create or replace view embeddings as select * from '{data}/embeddings.parquet'")
    got = sm.report(spark.read.parquet(f"{data}/embeddings.parquet")).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(duckdb.sql(sm.ORACLE).fetchall())


def test_query_has_the_columns_of_its_sql(spark, data):
    import duckdb

    from spandrel.llm.queries import QUERIES

    duckdb.sql(f"create or replace view embeddings as select * from '{data}/embeddings.parquet'")
    got, want = QUERIES["op13_sort_means"](spark, str(data)), duckdb.sql(sm.ORACLE)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())
