"""Exact top-k inner products with MaxScore over dimensions as query terms.

Vectors become integer rows, floor(scale * x). Within a shard a dimension's postings are the shard's column, and the
score of a dimension is measured from its smallest possible contribution, so that all scores are non-negative and each
query term has an upper bound. Terms are ordered by their bounds; for each query the *non-essential* ones are those whose
bounds together cannot lift a candidate over the k-th best score so far. All postings of the essential terms are
traversed (one product of matrices for a block of queries with like splits), and only candidates whose partial score plus
the remaining bounds is still competitive are probed in the other terms, in chunks of falling bounds, and dropped as
soon as they are not. A task's first shard is small, since it has no k-th best to split by. Shards hand on their k best; their merge is a ranked union of at most k rows per query and shard.

The queries are taken in blocks of a bounded number of rows, each broadcast and run against all shards. Arithmetic is on
float64 while all sums stay below 2^53, else on Python integers, so it is exact either way; a score outside 64 bits is
given as the nearest 64-bit value.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; components that only
one of two vectors has count as 0; ties go to the smaller id; rows that repeat an id are candidates each, and a query's
own id is never a candidate of it; null ids take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, plain

SHARD = 4096
#: Rows of a task's first shard; it has no bound to prune by yet, and shards double up to SHARD.
FIRST_SHARD = 128
EXACT = 1 << 53


def _matrix(rows: list, scale: float) -> np.ndarray:
    """Integer rows; float64 where that is exact, else Python integers."""
    dims = max(map(len, rows), default=0)
    x = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.isfinite(y).all() and (np.abs(y).max(initial=0) ** 2) * max(dims, 1) < EXACT / 4:
        return y
    import math

    return np.array([[math.floor(v * int(scale)) if abs(v) < 2**52 else int(v) * int(scale) for v in r] for r in x.tolist()], object).reshape(x.shape)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)


class Block:
    """A block of queries with the best candidates so far of each."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, chunk: int = 8):
        self.ids, self.q, self.k, self.chunk = ids, q, k, chunk
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, q.dtype)) for _ in ids]
        self.probed = 0  # candidates that a chunk of non-essential terms was looked up for
        self.products = 0  # (candidate, term) products

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.best[i][0], ids), np.append(self.best[i][1], scores)
        top = _best(ids, scores, self.k)
        self.best[i] = ids[top], scores[top]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Score a shard."""
        q = self.q
        if q.dtype == object or x.dtype == object:
            q, x = q.astype(object), x.astype(object)
        dims = min(q.shape[1], x.shape[1])
        q, x = q[:, :dims], x[:, :dims]
        if not dims:
            for i, own in enumerate(self.ids):
                c = ids[ids != own]
                self._keep(i, c, np.zeros(len(c), x.dtype))
            return
        a, b = q * x.min(axis=0), q * x.max(axis=0)
        floor, gain = np.minimum(a, b), np.abs(b - a)  # of each term: the least it gives, and its bound above that
        order = np.argsort(-gain.max(axis=0).astype(float), kind="stable")
        q, x, gain = q[:, order], x[:, order], gain[:, order]
        base = floor.sum(axis=1)
        rest = np.concatenate([np.cumsum(gain[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1), gain.dtype)], axis=1)
        low = floor[:, order]
        limit = [s[-1] if len(s) == self.k else None for _, s in self.best]
        # Terms from `split` on are non-essential: with them alone no candidate comes near the k-th best.
        split = np.array([dims if t is None else int(np.argmax(base[i] + rest[i] < t)) if base[i] + rest[i][-1] < t else dims for i, t in enumerate(limit)])
        split = np.minimum(-(-split // self.chunk) * self.chunk, dims)
        for s in np.unique(split):
            which = np.flatnonzero(split == s)
            partial = q[which, :s] @ x[:, :s].T
            self.products += len(which) * len(x) * int(s)
            for row, i in enumerate(which):
                self._finish(i, int(s), partial[row], ids, q[i], x, low[i], rest[i], limit[i])

    def _finish(self, i: int, at: int, partial: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, low: np.ndarray, rest: np.ndarray, limit) -> None:
        alive = np.flatnonzero(ids != self.ids[i])
        score = partial[alive]
        while True:
            if limit is not None:
                able = score + low[at:].sum() + rest[at] >= limit
                alive, score = alive[able], score[able]
            if at >= len(q) or not len(alive):
                break
            to = min(at + self.chunk, len(q))
            self.probed += len(alive)
            self.products += len(alive) * (to - at)
            score = score + x[alive, at:to] @ q[at:to]
            at = to
        if len(alive):
            self._keep(i, ids[alive], score)


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vectors, i, v = plain(vectors, id_col, vector_col)
    v = F.col(v).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(F.col(i).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def top_k(vectors: DataFrame, is_query: Callable, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, id, score) for the rows that ``is_query(column of ids)`` selects, against all rows."""
    rows = _clean(vectors, id_col, vector_col)
    asked = checkpoint(rows.filter(is_query(F.col("id"))))
    sc = vectors.sparkSession.sparkContext
    parts = []

    def run_block(block: list, last: bool) -> DataFrame:
        shared = sc.broadcast((np.array([r["id"] for r in block], np.int64), _matrix([r["v"] for r in block], scale)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, size = Block(*shared.value, k), FIRST_SHARD
            for b in batches:
                at = 0
                while at < b.num_rows:
                    part = b.slice(at, size)
                    own.add(np.asarray(part.column(0)), _matrix(part.column(1).to_numpy(zero_copy_only=False), scale))
                    at, size = at + size, min(2 * size, SHARD)
            out = [(int(q), int(i), max(-(1 << 63), min(int(s), (1 << 63) - 1))) for q, (ids, scores) in zip(own.ids, own.best, strict=True) for i, s in zip(ids, scores, strict=True)]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "id", "score"])

        found = rows.mapInArrow(run, "query_id long, id long, score long")
        ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        best = found.withColumn("rank", ranked).filter(F.col("rank") <= k)
        if last:
            return best
        best = checkpoint(best)
        shared.unpersist()
        return best

    block: list = []
    for r in asked.toLocalIterator(prefetchPartitions=False):
        block.append(r)
        if len(block) == block_rows:
            parts.append(run_block(block, False))
            block = []
    if block or not parts:
        parts.append(run_block(block, True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


ORACLE = """
with v as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
           where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select * from v where vec_id % 50 = 0),
s as (select q.vec_id as query_id, v.vec_id as vec_id, cast(list_sum([p[1] * p[2] for p in list_zip(q.e, v.e)]) as bigint) as score
      from q, v where q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""
