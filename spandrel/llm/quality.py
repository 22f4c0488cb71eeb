"""Quality by histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and the word hashes of whole texts. Trees are complete binary trees of a fixed depth, kept
as flat arrays (feature and threshold of inner nodes, values of leaves), so that a batch of documents walks down all trees
at once by array indexing. Training bins each statistic by quantiles and grows trees level by level from histograms of
gradients; it sees a bounded sample of ``max_rows`` labelled rows (smallest hashes of the id), as statistics, not texts.

Defined cases: null and empty texts have all statistics 0 and are scored like others; ids with several labels take the
smallest, of texts that repeat an id the least statistics teach; null labels teach nothing; without labels of both kinds every score is the share of label 1 (1.0 if there is no
label at all); repeated rows are scored each; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, plain
from .shingles import mix, word_hashes

CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "high": bytes(range(128, 256)), "space": b" ", "line": b"\n",
    "stop": b".", "comma": b",", "exclaim": b"!", "question": b"?", "bar": b"|", "sign": b"#$%&*@^~=+<>", "bracket": b"()[]{}", "quote": b"\"'`", "dash": b"-_/\\", "colon": b":;",
}
_GROUPS = np.zeros((256, len(CLASSES)))
for _i, _b in enumerate(CLASSES.values()):
    _GROUPS[list(_b), _i] = 1
NAMES = [
    "chars", *CLASSES, "words", "word_length", "distinct", "commonest", "repeated_next", "distinct_pairs", "commonest_pair", "lines", "distinct_lines", "line_length", "longest_line",
    "line_stops", "entropy", "words_per_stop",
]


def statistics(text: bytes | None) -> np.ndarray:
    out = np.zeros(len(NAMES))
    b = text or b""
    if not b:
        return out
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    n = len(b)
    groups = counts @ _GROUPS
    w = word_hashes(b)
    share = counts[counts > 0] / n
    lines = [x for x in b.split(b"\n") if x]
    values = [np.log1p(n), *(groups / n)]
    if len(w):
        _, c = np.unique(w, return_counts=True)
        values += [np.log1p(len(w)), n / len(w), len(c) / len(w), c.max() / len(w)]
        if len(w) > 1:
            _, p = np.unique(mix(w[:-1], 1) + w[1:], return_counts=True)
            values += [(w[1:] == w[:-1]).mean(), len(p) / (len(w) - 1), p.max() / (len(w) - 1)]
        else:
            values += [0.0, 1.0, 1.0]
    else:
        values += [0.0] * 7
    longest = max(map(len, lines), default=0)
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    values += [np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), longest, ends / max(1, len(lines)), -(share * np.log2(share)).sum(), len(w) / (1 + groups[list(CLASSES).index("stop")])]
    out[:] = values
    return out


@dataclass
class Forest:
    """Trees of depth ``depth`` in flat arrays; node i has the children 2i + 1 and 2i + 2."""

    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        margin = self.base + self.value[trees, at - (1 << self.depth) + 1].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 64, damping: float = 1.0, least: float = 3.0) -> Forest:
    """Boosting on the logistic loss."""
    prior = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
    inner = (1 << depth) - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(depth, 40.0 if prior > 0.5 else -40.0, np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, inner + 1)))
    n, features = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(features)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    edge = np.full((features, bins), np.inf)
    for j, c in enumerate(cuts):
        edge[j, : len(c)] = c
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best, pick_f, pick_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(features):
                at = local * bins + code[:, j]
                gl = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hl = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + damping) + (gt - gl) ** 2 / (ht - hl + damping) - gt**2 / (ht + damping)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = -1
                gain[:, len(cuts[j]) :] = -1
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], pick_f[better], pick_b[better] = top[better], j, k[better]
            ok = pick_b >= 0
            f[first : first + width] = pick_f
            t[first : first + width][ok] = edge[pick_f[ok], pick_b[ok]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + damping)
        margin += value[leaf]
        all_f.append(f)
        all_t.append(t)
        all_v.append(value)
    return Forest(depth, base, np.array(all_f), np.array(all_t), np.array(all_v))


def _statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., x) for docs (keep..., t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for at in range(0, b.num_rows, 256) for t in b.column(b.num_columns - 1).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "t").mapInArrow(run, f"{kinds}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **options) -> Forest:
    """A forest from the labelled rows whose crc32 of the id, modulo 4, is not 2."""
    labels, i, y = plain(labels, id_col, label_col)
    train = labels.filter(F.col(y).isNotNull() & F.col(i).isNotNull() & (crc_mod(i, 4) != 2))
    train = train.groupBy(F.col(i).alias("id")).agg(F.min(y).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    docs, i, t = plain(docs, id_col, text_col)
    sample = docs.select(F.col(i).alias("id"), F.col(t).cast("string").cast("binary").alias("t")).join(F.broadcast(train), "id")
    # Of rows that repeat an id the least statistics teach, so no more than max_rows rows come to the driver.
    rows = _statistics(sample, ["id", "y"]).groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toArrow().to_pandas().sort_values("id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    return fit(x, rows["y"].to_numpy(float), **options)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.array([statistics(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x))], ["id", "score"])

    docs, i, t = plain(docs, id_col, text_col)
    src = docs.select(F.col(i).alias("id"), F.col(t).cast("string").cast("binary").alias("t"))
    rows = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")
    return rows.select(F.col("id").alias(id_col), (crc_mod("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
