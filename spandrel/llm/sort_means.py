"""Centroid clustering of integer vectors by sort-means.

Every round keeps, beside each vector, the centroid it was assigned to, and orders the other centroids by their distance
from that one. A vector scans this list from its own centroid on and stops at the first centroid that is strictly farther
from its own centroid than twice the vector's distance to it: by the triangle inequality all from there on are farther from
the vector too. Equal distances are still scanned, so ties go to the smaller number exactly.

Vectors become integers, so distances, sums and means are exact and do not depend on how rows are dealt out. A round is one
narrow pass in Arrow batches, written in the shared folder (a few bits a component), and one aggregate that combines sums
before it shuffles; the driver sees ``k`` rows of sums. The table of the round before goes once the next is written.

Defined cases: vectors that are null, of another length, or that hold a null or a non-finite component take no part; rows
with a repeated or null id are vectors of their own (null ids are the last to become first centroids); equal first hashes
are ordered by components; with fewer vectors than ``k`` each becomes a centroid; a centroid without vectors stays as it is;
no vectors give no rows; other columns may have any names. A component so large that its squared distance could exceed a
long is an error, never a wrong result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder, drop_folder, plain


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 64) -> DataFrame:
    """(id, x): floor(scale * component) of the vectors that take part."""
    most = math.isqrt((1 << 61) // dim) // 2
    rows, i, v = plain(vectors, id_col, vec_col)
    whole = (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    number = lambda c: F.when(F.abs(c.cast("double") * scale) < most, F.floor(c.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))
    return rows.filter(whole).select(F.col(i).cast("long").alias("id"), F.transform(v, number).alias("x"))


def first_centroids(rows: DataFrame, k: int = 16, seed: str = "1:") -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 of seed and id."""
    mark = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    found = rows.select(mark.alias("mark"), "x").orderBy(F.asc_nulls_last("mark"), "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, distances computed) of each row of ``x``, scanned from the centroid ``before`` it had."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    cluster, distance, work = before.copy(), np.zeros(len(x), np.int64), np.ones(len(x), np.int32)
    for p in np.unique(before):
        rows = np.flatnonzero(before == p)
        points = x[rows]
        own = ((points - centroids[p]) ** 2).sum(1)
        best, number, still = own.copy(), np.full(len(rows), p, before.dtype), np.arange(len(rows))
        for j in np.argsort(between[p], kind="stable"):
            if j == p:
                continue
            still = still[between[p, j] <= 4 * own[still]]
            if not len(still):
                break
            d = ((points[still] - centroids[j]) ** 2).sum(1)
            work[rows[still]] += 1
            nearer = (d < best[still]) | ((d == best[still]) & (j < number[still]))
            best[still[nearer]], number[still[nearer]] = d[nearer], j
        cluster[rows], distance[rows] = number, best
    return cluster, distance, work


def _pass(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, x, cluster, distance, compared): every vector at its nearest centroid."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                lists = part.column(1)
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                cluster, distance, work = assign(x, part.column(2).to_numpy(zero_copy_only=False).astype(np.int32), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(work, pa.int32())], ["id", "x", "cluster", "distance", "compared"])

    return rows.select("id", "x", "cluster").mapInArrow(run, "id long, x array<long>, cluster int, distance long, compared int")


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of the mean of their vectors; those without vectors stay."""
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # as many rows as centroids
        out[r["cluster"]] = [s // r["n"] for s in r[2:]]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """((id, x, cluster, distance, compared), centroids) after ``rounds`` rounds and one more assignment."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vec_col, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id long, x array<long>, cluster int, distance long, compared int"), centroids
    folder = f"{checkpoint_folder(spark)}/sort-means-{uuid.uuid4().hex}"
    table = rows.withColumn("cluster", F.lit(0))
    for r in range(rounds + 1):
        _pass(table, centroids).write.parquet(f"{folder}/{r}")
        table = spark.read.parquet(f"{folder}/{r}")
        if r:
            drop_folder(spark, f"{folder}/{r - 1}")
        if r < rounds:
            centroids = moved(table, centroids)
    return table, centroids


def report(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared), a row per vector that takes part."""
    table, centroids = cluster(vectors, **how)
    spark = vectors.sparkSession
    total = table.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # as many rows as centroids
    whole = sum(r["d"] for r in total)
    told = [(r["cluster"], r["d"], whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in total]
    each = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return table.join(each, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def _oracle(rounds: int = 3, k: int = 16) -> str:
    """The same by plain comparison of every vector with every centroid."""
    parts = [
        "t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64)",
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM t WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM kept) WHERE c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT k.rid, c.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS d FROM kept k, c{r} c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT rid, c, d, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS o FROM d{r}) WHERE o = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT a.c, i, sum(k.v[i]) AS s, count(*) AS n FROM a{r} a JOIN kept k USING (rid), range(1, 65) g(i) GROUP BY a.c, i)")
            parts.append(f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))")
    end = f"SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept k USING (rid) JOIN c{rounds} c USING (c)"
    return "WITH " + ",\n".join(parts) + "\n" + end


ORACLE = _oracle()
