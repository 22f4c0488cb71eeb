"""Best-fit packing of tokenised documents into sequences, with a Martello-Toth reduction first.

What decides is the histogram of piece lengths: it has ``capacity`` rows at most, whatever the corpus, so the plan is made
on the driver and the pieces are placed by it in parallel.

1. A document is tokenised as a whole, id 0 appended, and cut only if longer than the capacity (the first piece takes
   the remainder, the others are full).
2. Reduction (Martello and Toth, 1990): for one open length j after the other, from the longest on, a set that holds j
   and provably dominates all other sets with j is fixed for good: j alone if nothing fits beside it; j with a length that fills the sequence; j with
   the longest length k that fits, if no two open pieces fit beside j; j with a pair, if no three fit beside j, no
   single piece dominates it and one pair is at least as long, piece for piece, as any other that fits. Lengths are fixed
   in bulk, as often as their counts allow, the procedure goes on with the smaller instance, and passes over all lengths
   are repeated until one fixes nothing.
3. Where no such set exists the remainder is packed best-fit decreasing, in bulk by (room, sequences) groups.

The plan is a list of placements "pieces number a to b of length l go to the sequences from s on, k in each, at offset o".
A piece's number within its length comes from a count per (bucket, length) and its rank within the bucket; buckets are
dealt by a hash of the document id, so that one length, even that of a third of all pieces, spreads over all of them.

Defined cases: a null or empty text is one piece, id 0 alone; repeated rows are packed as separate documents; null ids
are ids like any other; no documents give no rows; other columns may have any names and are never looked at. The string
of an added token in a text gives that token's id, as ``tokenizers`` does by default.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, plain, plan_bytes

CAPACITY = 2048


# ---- tokenising ------------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them, those of added tokens included.

    Where a byte-level vocabulary numbers its tokens in the order of its merges, merging by rank is the same thing, and the
    ids come from ``tiktoken`` over that vocabulary, which is several times faster. Any other file goes to ``tokenizers``,
    and so does one whose added tokens take more than their own string.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, added = whole["model"], whole.get("added_tokens") or []
        simple = not whole.get("normalizer") and not any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word"))
        letters, vocabulary = _byte_letters(), model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        first = len(vocabulary) - len(merges)
        ordered = sorted(vocabulary.get("".join(m), -1) for m in merges) == [vocabulary.get("".join(m), -2) for m in merges]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.fast = self.tokenizer = None
        if model["type"] == "BPE" and simple and ordered and first >= 256 and all(bytes([b]) in ranks for b in range(256)):
            merged = {bytes(letters[c] for c in "".join(m)) for m in merges}
            import tiktoken

            special = {a["content"]: a["id"] for a in added}
            ranks = {t: i for t, i in ranks.items() if i not in special.values() and (len(t) == 1 or t in merged)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is not None:
            return [self.fast.encode_to_numpy(t, allowed_special="all") for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if (path, pattern) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = n % capacity
    pieces = [(0, head)] if head else []
    return pieces + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a row per piece, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    rows += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs, i, t = plain(docs, id_col, text_col)
    src = docs.select(F.col(i).cast("long").alias("i"), F.col(t).cast("string").alias("t"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the plan --------------------------------------------------------------------------------------------------------


class Plan:
    """Placements of the pieces of a histogram {length: count}; ``reduced`` sequences come from the reduction, ``alone`` of them hold one full piece."""

    alone = 0

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 2, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.used = np.zeros(capacity + 2, np.int64)
        self.sequences = 0
        #: (length, first number, first sequence, sequences, pieces in each, offset)
        self.placements: list[tuple[int, int, int, int, int, int]] = []
        self.reduced = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, sequence: int, sequences: int, each: int, offset: int) -> None:
        self.placements.append((length, int(self.used[length]), sequence, sequences, each, offset))
        self.used[length] += sequences * each
        self.left[length] -= sequences * each

    def _longest(self, room: int, below: int | None = None) -> int:
        """The longest open length of at most ``room``; 0 if none."""
        fit = np.flatnonzero(self.left[1 : min(room, self.capacity) + 1])
        return int(fit[-1]) + 1 if len(fit) else 0

    def _shortest(self, n: int) -> list[int]:
        """The ``n`` shortest open pieces (with repeats), or fewer."""
        out: list[int] = []
        for length in np.flatnonzero(self.left):
            out += [int(length)] * min(n - len(out), int(self.left[length]))
            if len(out) == n:
                break
        return out

    def _fix(self, lengths: list[int]) -> None:
        """Fix the set of these lengths as often as the counts allow."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(self.left[x]) // n for x, n in need.items())
        offset = 0
        for x, n in need.items():
            self._place(x, self.sequences, times, n, offset)
            offset += n * x
        self.sequences += times
        self.reduced += times
        self.alone += times if lengths == [self.capacity] else 0

    def _dominating(self, j: int) -> list[int] | None:
        """A set with the open length j that dominates every other set with j, or None."""
        room = self.capacity - j
        self.left[j] -= 1
        try:
            k = self._longest(room)
            if not k:
                return [j]
            if k == room:
                return [j, k]
            low = self._shortest(3)
            if len(low) < 2 or sum(low[:2]) > room:
                return [j, k]
            if len(low) == 3 and sum(low) <= room:
                return None
            # At most two fit beside j. The pair a + b must be at least as good as k and as every other pair: it fills the
            # room, or it has the longest length that leaves room for another and no pair has a longer second one.
            a = self._longest(room - low[0])
            self.left[a] -= 1
            b = self._longest(room - a)
            self.left[a] += 1
            if not b or k > a:
                return None
            a, b = max(a, b), min(a, b)
            second = self._best_second(room)
            return [j, a, b] if second <= b else None
        finally:
            self.left[j] += 1

    def _best_second(self, room: int) -> int:
        """The longest length that is the shorter of some pair within ``room``."""
        for length in np.flatnonzero(self.left[: room // 2 + 1])[::-1]:
            self.left[length] -= 1
            other = self._longest(room - int(length))
            self.left[length] += 1
            if other >= length:
                return int(length)
        return 0

    def _reduce(self) -> None:
        before = -1
        while before != self.reduced:
            before = self.reduced
            for j in map(int, np.flatnonzero(self.left)[::-1]):
                while self.left[j] and (found := self._dominating(j)):
                    self._fix(found)

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
        for length in map(int, np.flatnonzero(self.left)[::-1]):
            while n := int(self.left[length]):
                room = min((r for r in open_ if r >= length), default=0)
                if not room:
                    room, count = self.capacity, -(-n // (self.capacity // length))
                    open_[room] = [(self.sequences, count)]
                    self.sequences += count
                first, count = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                each = min(room // length, n)
                full = min(count, n // each)
                self._place(length, first, full, each, self.capacity - room)
                for start, many, rest in ((first, full, room - each * length), (first + full, count - full, room)):
                    if many and rest:
                        open_.setdefault(rest, []).append((start, many))


# ---- placing ---------------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. ``buckets``: by default they follow the input's size."""
    buckets = buckets or min(1 << 16, max(1024, plan_bytes(docs) >> 24))
    parts = checkpoint(pieces(docs, tokenizer_path, pattern, id_col, text_col, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    counts = checkpoint(parts.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    plan = Plan({r["length"]: r["n"] for r in histogram}, capacity)
    table = np.array(sorted(plan.placements), np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    # buckets rows at most for each length
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = parts.withColumn("number", within).join(before, ["bucket", "length"]).withColumn("number", F.col("number") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        shift = np.int64(1) << np.int64(48)
        keys = t[:, 0] * shift + t[:, 1]
        for b in batches:
            length, number = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "number"))
            row = t[np.searchsorted(keys, length * shift + number, "right") - 1]
            inside = number - row[:, 1]
            sequence, offset = row[:, 2] + inside // row[:, 4], row[:, 5] + inside % row[:, 4] * length
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    out = out.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
