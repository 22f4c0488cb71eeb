"""Token counts that survive edits: a segment tree of pre-tokens per document.

Leaves are segments of successive pre-tokens with their lengths and token counts; inner nodes hold sums of characters and
tokens. An edit descends to the segments it touches, splits the text anew from the last pre-token border that cannot be
affected (a pre-token looks at two characters behind its end at most) up to the first border that old and new text share
behind the edit, encodes what lies between, and updates the sums on the paths to the root. Everything else is neither
split nor encoded again.

Defined cases: null and empty texts have 0 tokens; edits are clipped to the text as it stands when they are applied, in
their given order; repeated rows are counted each; a null list of edits is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import compile_pattern, load_ranks
from .common import plain, without_collector

#: Characters behind its end that a pre-token's match may depend on.
AHEAD = 2
LEAF = 64


class PieceCounts(dict):
    """Pre-token -> its number of tokens, by the ``tiktoken`` library; kept in two generations of a bounded size."""

    def __init__(self, ranks_path: str, pattern: str, limit: int = 400_000):
        import tiktoken

        super().__init__()
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={}).encode_ordinary
        self.split = compile_pattern(pattern).findall
        self.limit, self.older = limit, {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        n = self.older.get(piece)
        if n is None:
            n = len(self.encode(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


_counts: dict[tuple[str, str], PieceCounts] = {}


def piece_counts(ranks_path: str, pattern: str) -> PieceCounts:
    """The worker's counts, kept from task to task."""
    if (ranks_path, pattern) not in _counts:
        _counts[ranks_path, pattern] = PieceCounts(ranks_path, pattern)
    return _counts[ranks_path, pattern]


class SumTree:
    """Sums of (characters, tokens) over a list of leaves; a leaf's row changes in O(log leaves)."""

    def __init__(self, leaves: np.ndarray):
        self.size = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.node = np.zeros((2 * self.size, 2), np.int64)
        self.node[self.size : self.size + len(leaves)] = leaves
        level = self.size
        while level > 1:
            half = level // 2
            self.node[half:level] = self.node[level : 2 * level : 2] + self.node[level + 1 : 2 * level : 2]
            level = half

    def set(self, leaf: int, row: tuple[int, int]) -> None:
        i = self.size + leaf
        self.node[i] = row
        while i > 1:
            i //= 2
            self.node[i] = self.node[2 * i] + self.node[2 * i + 1]

    def find(self, position: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds a character position."""
        i, before = 1, 0
        while i < self.size:
            left = int(self.node[2 * i, 0])
            i, before = (2 * i + 1, before + left) if position >= before + left else (2 * i, before)
        return i - self.size, before

    @property
    def total(self) -> tuple[int, int]:
        return int(self.node[1, 0]), int(self.node[1, 1])


class Document:
    """A text with its count. ``split(text)`` gives pre-tokens, ``count(piece)`` a pre-token's tokens."""

    def __init__(self, text: str, split: Callable, count: Callable):
        self.text, self.split, self.count = text, split, count
        self.encoded = 0
        pieces = split(text)
        lengths, tokens = self._measure(pieces)
        self.leaves = [(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self._plant()

    def _measure(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        self.encoded += len(pieces)
        return list(map(len, pieces)), list(map(self.count, pieces))

    def _plant(self) -> None:
        self.tree = SumTree(np.array([(sum(a), sum(b)) for a, b in self.leaves], np.int64).reshape(-1, 2))

    @property
    def tokens(self) -> int:
        return self.tree.total[1]

    @property
    def pieces(self) -> int:
        return sum(len(a) for a, _ in self.leaves)

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace ``text[start:end]`` by ``put``."""
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(max(end, start), len(old))
        self.text = old[:start] + put + old[end:]
        shift = len(put) - (end - start)
        last = len(self.leaves) - 1
        # The first segment that may hold an affected pre-token, and there the first such pre-token.
        leaf, at = self.tree.find(max(0, start - AHEAD))
        leaf = min(leaf, last)
        while leaf > 0 and (at > start - AHEAD or not self.leaves[leaf][0]):
            leaf -= 1
            at -= int(self.tree.node[self.tree.size + leaf, 0])
        head = 0
        lengths, tokens = self.leaves[leaf]
        border = at
        while head < len(lengths) and border + lengths[head] + AHEAD <= start:
            border += lengths[head]
            head += 1
        # Split anew from that border, a window at a time, until a border of the new text is one of the old text.
        right, right_at = leaf, at  # segments up to `right` are open; their old borders are known
        old_borders: dict[int, tuple[int, int]] = {}

        def open_segment(k: int, begin: int) -> int:
            for i, n in enumerate(self.leaves[k][0]):
                old_borders.setdefault(begin, (k, i))
                begin += n
            return begin

        right_at = open_segment(right, at)
        fresh: list[str] = []
        pos, window = border, max(256, 2 * len(put) + 256)
        meet = None
        while meet is None:
            stop = min(len(self.text), max(pos, end + shift) + window)
            part = self.split(self.text[pos:stop])
            if stop < len(self.text):  # the last pieces may depend on what lies behind the window
                keep, n = 0, pos
                while keep < len(part) and n + len(part[keep]) + AHEAD <= stop:
                    n += len(part[keep])
                    keep += 1
                part = part[:keep]
            if not part and stop < len(self.text):
                window *= 4
                continue
            for piece in part:
                fresh.append(piece)
                pos += len(piece)
                if pos >= end + shift:
                    while right < last and right_at <= pos - shift:
                        right += 1
                        right_at = open_segment(right, right_at)
                    if pos - shift in old_borders:
                        meet = old_borders[pos - shift]
                        break
            if meet is None and pos >= len(self.text):
                meet = (last + 1, 0)
        new_lengths, new_tokens = self._measure(fresh)
        if meet[0] <= last:
            tail_lengths, tail_tokens = self.leaves[meet[0]]
            tail = tail_lengths[meet[1] :], tail_tokens[meet[1] :]
        else:
            tail = [], []
        merged = lengths[:head] + new_lengths + tail[0], tokens[:head] + new_tokens + tail[1]
        touched = range(leaf, min(meet[0], last) + 1)
        if len(merged[0]) <= 4 * LEAF:
            self.leaves[leaf] = merged
            for k in touched[1:]:
                self.leaves[k] = ([], [])
            for k in touched:
                self.tree.set(k, (sum(self.leaves[k][0]), sum(self.leaves[k][1])))
        else:  # many pieces: new segments, and sums over all of them
            self.leaves[leaf : touched[-1] + 1] = [(merged[0][i : i + LEAF], merged[1][i : i + LEAF]) for i in range(0, len(merged[0]), LEAF)]
            self._plant()


def standard_edits(text: Column) -> Column:
    """Three edits of every text: a deletion of ten characters at a third, a note in the middle, a line at the end."""
    n = F.length(text)
    one = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(t).alias("put"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return F.array(one(third, third + 10, ""), one(half, half, " [checked 2024] "), one(n + 6, n + 6, "\nEnd of the reviewed text."))


def count_with_edits(docs: DataFrame, ranks_path: str, pattern: str, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_tokens_edited, n_pretokens, n_reencoded. ``edits``: array of (start, end, put), applied in turn."""
    i, t = id_col, text_col
    if edits is None:
        docs, i, t = plain(docs, id_col, text_col)
    text = F.coalesce(F.col(t).cast("string"), F.lit(""))
    src = docs.select(F.col(i).alias("id"), text.alias("t"), (standard_edits(text) if edits is None else edits).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_counts(ranks_path, pattern)
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                with without_collector():
                    for t, edits_of in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        doc = Document(t, known.split, known.__getitem__)
                        before, pieces = doc.tokens, doc.encoded
                        for e in edits_of or []:
                            doc.edit(e["start"] or 0, e["end"] or 0, e["put"] or "")
                        out.append((before, doc.tokens, pieces, doc.encoded - pieces))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["id", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long").withColumnRenamed("id", id_col)
