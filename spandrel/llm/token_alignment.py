"""Alignment of two tokenizers over the same bytes.

The ends of the A tokens and those of the B tokens cut a text into elementary intervals: their union in order. The owners of
an interval are found by binary search in either list of ends; each interval is one overlap of an A with a B token. An end
that both share closes a group of tokens that cover the same bytes. Texts of a task are laid end to end, so all this is
done for many texts at once; groups never reach over the end of a text, which both sides share.

What counts as a link is a parameter: ``"end"`` (pairs whose byte ranges end together), ``"overlap"`` (pairs that share
bytes) or ``"group"`` (each A with each B token of a group). How often an id pair is linked in the whole corpus is counted
by id pair: a task counts the pairs of a million links (a chunk) before anything is shuffled, chunk counts are added up
by pair, and the sums go back to the chunks that hold the pair, by joins. Links are numbered by the pairs of their chunk
(4 bytes each) and meet the corpus counts in one group per chunk, so a group is bounded by ``chunk_links`` and one text.

A text takes a leading space, as the piece tokenizer gives it; strings of special tokens are ordinary text. Token bytes are
those of the vocabulary entries, so a text that a tokenizer changes (normalises, or cannot spell) shows it.

Defined cases: a text that is null, empty, or whose joined A or B bytes differ from space and text has no tokens: zeros, and
an empty string for the hash; repeated rows and ids are documents of their own; ids may be null; no documents give no rows;
very long texts are aligned whole; other columns may have any names and are never looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder, plain
from .packing import _byte_letters, encoder

#: Links of a chunk, and bytes of text that are aligned at once.
CHUNK_LINKS, STRETCH = 1 << 20, 1 << 19
#: A table of so many B ids is broadcast; no vocabulary of more is.
BROADCAST_IDS = 100_000


class Side:
    """A tokenizer: ids of many texts, the bytes of each id and how many they are."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.width = np.array([len(t) for t in tokens], np.int64)

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        return int(self.width[ids].sum()) == len(data) and b"".join(map(self.tokens.__getitem__, ids.tolist())) == data


class ByteLevel(Side):
    """A byte-level vocabulary of the ``tokenizers`` library; texts get a space in front."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters, ids = _byte_letters(), whole["model"]["vocab"] | {a["content"]: a["id"] for a in whole.get("added_tokens") or []}
        tokens = [b""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        super().__init__(tokens)
        self._ids = encoder(path, pattern)
        if self._ids.tokenizer is not None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(path)
            self._slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self._ids.fast is not None:
            return [self._ids.fast.encode_to_numpy(f" {t}", disallowed_special=()).astype(np.int64) for t in texts]
        return [np.array(e.ids, np.int64) for e in self._slow.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces(Side):
    """A model of the ``sentencepiece`` library, which puts the space in front itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = m = SentencePieceProcessor(model_file=path)
        one = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        super().__init__([one(i) for i in range(m.get_piece_size())])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self._model.encode(texts, num_threads=1)]


_sides: dict[tuple[str, ...], Side] = {}


def sides(a_path: str, pattern: str, b_path: str) -> tuple[Side, Side]:
    """The worker's tokenizers, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    for key, make in (((a_path, pattern), ByteLevel), ((b_path,), Pieces)):
        if key not in _sides:
            _sides[key] = make(*key)
    return _sides[a_path, pattern], _sides[b_path,]


class Alignment:
    """Elementary intervals of tokens that cover the same bytes, given the ends of the A and of the B tokens."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray):
        self.ends = np.union1d(a_ends, b_ends)
        self.a, self.b = np.searchsorted(a_ends, self.ends), np.searchsorted(b_ends, self.ends)
        both = (a_ends[self.a] == self.ends) & (b_ends[self.b] == self.ends) if len(self.ends) else np.zeros(0, bool)
        #: Of each group: its end, its last A and its last B token, and how many of each it has.
        self.group_ends, self.last_a, self.last_b = self.ends[both], self.a[both], self.b[both]
        self.n_a, self.n_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, end of the group or interval) of each link."""
        if kind == "end":
            return self.last_a, self.last_b, self.group_ends
        if kind == "overlap":
            return self.a, self.b, self.ends
        many = self.n_a * self.n_b
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        n_b = np.repeat(self.n_b, many)
        first_a, first_b = self.last_a - self.n_a + 1, self.last_b - self.n_b + 1
        return np.repeat(first_a, many) + within // n_b, np.repeat(first_b, many) + within % n_b, np.repeat(self.group_ends, many)

    def spelled(self, a_ids: np.ndarray, b_ids: np.ndarray, words: np.ndarray, of_b: int) -> np.ndarray:
        """All ids, group by group, A before B, each with the sign behind it, as fixed-width strings of ``words``."""
        a_codes, b_codes = a_ids * 2, (b_ids + of_b) * 2
        a_codes[self.last_a] += 1
        b_codes[self.last_b] += 1
        out = np.empty(len(a_ids) + len(b_ids), np.int64)
        out[np.arange(len(a_ids)) + np.repeat(self.last_b - self.n_b + 1, self.n_a)] = a_codes
        out[np.arange(len(b_ids)) + np.repeat(self.last_a + 1, self.n_b)] = b_codes
        return words[out]


def _words(a: Side, b: Side) -> np.ndarray:
    """Decimal ids, twice each: before another id of its side (,) and as the last of a group (| after A, ; after B)."""
    return np.array([f"{i}{s}" for n, last in ((len(a.tokens), "|"), (len(b.tokens), ";")) for i in range(n) for s in (",", last)], "S")


def _aligned(docs: DataFrame, a_path: str, pattern: str, b_path: str, link: str, chunk_links: int) -> DataFrame:
    """A row per document with its links numbered within its chunk, and a row per chunk with its id pairs and their counts."""
    shape = "chunk long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, pattern, b_path)
        words = _words(a, b)
        task, made = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        codes: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            """The documents and the pairs of a chunk."""
            nonlocal made
            chunk, made = task + made, made + 1
            pairs, number, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            number, at, out = number.astype("<i4"), 0, []
            for r in rows:
                out.append((*r, number[at : at + r[4]].tobytes()))
                at += r[4]
            rows.clear()
            codes.clear()
            n, cols = len(out), list(zip(*out, strict=True))
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string()), pa.array(cols[6], pa.binary()), none, none], names)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), *lists], names)

        def align(ids: list, texts: list) -> None:
            good = [t for t in texts if t]
            spelt = [(x, y, len(d)) if a.spells(x, d) and b.spells(y, d) else None for x, y, d in zip(a.encode(good), b.encode(good), (f" {t}".encode() for t in good), strict=True)] if good else []
            kept = [s for s in spelt if s]
            if kept:
                a_ids, b_ids = np.concatenate([s[0] for s in kept]), np.concatenate([s[1] for s in kept])
                found = Alignment(np.cumsum(a.width[a_ids]), np.cumsum(b.width[b_ids]))
                bounds = np.cumsum([s[2] for s in kept])
                in_a, in_b, ends = found.links(link)
                n_groups, n_links = (np.diff(np.searchsorted(e, bounds, "right"), prepend=0).tolist() for e in (found.group_ends, ends))
                codes.append(a_ids[in_a] << 32 | b_ids[in_b])
                spelled, token = found.spelled(a_ids, b_ids, words, len(a.tokens)), 0
            k, good_ones = 0, iter(spelt)
            for i, t in zip(ids, texts, strict=True):
                if not t or not (s := next(good_ones)):
                    rows.append((i, 0, 0, 0, 0, ""))
                    continue
                n = len(s[0]) + len(s[1])
                line = spelled[token : token + n].tobytes().replace(b"\0", b"")[:-1]
                rows.append((i, len(s[0]), len(s[1]), n_groups[k], n_links[k], hashlib.sha256(line).hexdigest()))
                k, token = k + 1, token + n

        for batch in batches:
            at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), STRETCH, "right")))
                part = batch.slice(at, n)
                align(part.column(0).to_pylist(), part.column(1).to_pylist())
                at += n
                if sum(map(len, codes)) >= chunk_links:
                    yield from close()
        if rows:
            codes.append(np.zeros(0, np.int64))
            yield from close()

    names = [c.split()[0] for c in shape.split(", ")]
    return docs.mapInArrow(run, shape)


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", link: str = "end", chunk_links: int = CHUNK_LINKS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document, and (a, b, n, best) per linked id pair of the corpus."""
    spark = docs.sparkSession
    docs, i, t = plain(docs, id_col, text_col)
    folder = f"{checkpoint_folder(spark)}/alignment-{uuid.uuid4().hex}"
    _aligned(docs.select(F.col(i).cast("long").alias("id"), F.col(t).cast("string").alias("t")), a_path, pattern, b_path, link, chunk_links).write.parquet(folder)
    whole = spark.read.parquet(folder)
    entries = whole.filter("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "e")).select("chunk", "at", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    counts = entries.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", b_id)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of B
    counted = counts.join(F.broadcast(most) if len(sides(a_path, pattern, b_path)[1].tokens) <= BROADCAST_IDS else most, "b").select("pair", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    told = entries.select("chunk", "at", "pair").join(counted.select("pair", "n", "best"), "pair").select("chunk", "at", "n", "best")
    own = spark.read.parquet(folder).filter("pairs is null").select("chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")

    def score(mine: pa.Table, corpus: pa.Table) -> pa.Table:
        n = np.zeros(corpus.num_rows, np.int64)
        best = np.zeros(corpus.num_rows, np.int64)
        at = corpus.column("at").to_numpy()
        n[at], best[at] = corpus.column("n").to_numpy(), corpus.column("best").to_numpy()
        n_best, count_sum = [], []
        for links in mine.column("links").to_pylist():
            k = np.frombuffer(links, "<i4")
            n_best.append(int(best[k].sum()))
            count_sum.append(int(n[k].sum()))
        cols = {c: mine.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": mine.column("groups_sha256")}
        return pa.table(cols)

    out = own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    pairs = counted.select(F.shiftrightunsigned("pair", 32).cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n", "best")
    return out.withColumnRenamed("id", "doc_id"), pairs


def report(docs: DataFrame, a_path: str, pattern: str, b_path: str, **how) -> DataFrame:
    """The documents' part of ``align``."""
    return align(docs, a_path, pattern, b_path, **how)[0]
