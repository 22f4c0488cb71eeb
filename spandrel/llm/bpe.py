"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

A sequence of tokens is the BPE encoding of its bytes if and only if every two neighbours are the encoding of theirs.
So a non-deterministic machine can guess token ends: it walks the trie of the vocabulary and at a token's end checks the
token against the one before. :class:`Transducer` determinises it while it reads: a state is the set of guesses alive
(tokens not yet sure, place in the trie, last token), and what all guesses agree on is emitted at once, after as many
bytes as the longest token has at most. States and transitions are made on first use and kept up to a bound.

Texts are split into pre-tokens first, whose encodings are kept too, up to a bound. :class:`StreamDecoder` turns ids back
into text piece by piece; a byte-level machine for well-formed UTF-8, run token by token, tells where characters end.

Defined cases: null and empty texts have no ids, and the digests of no bytes; strings of special tokens are ordinary
text; repeated rows are encoded each; ill-formed input of the decoder becomes U+FFFD;
other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, without_collector

MANY = 1 << 60
# The code points with the property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"



def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ranges(major: str) -> str:
    """The code points of a general category's major class, as the inside of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def compile_pattern(pattern: str) -> re.Pattern:
    r"""``pattern`` for the standard library, with \p{L}, \p{N}, \s and \S spelt out."""
    sets = {r"\p{L}": _ranges("L"), r"\p{N}": _ranges("N"), r"\s": WHITE}
    out, at, inside = [], 0, False
    while at < len(pattern):
        name = next((k for k in (*sets, r"\S") if pattern.startswith(k, at)), None)
        if name:
            out.append(f"[^{WHITE}]" if name == r"\S" else sets[name] if inside else f"[{sets[name]}]")
            at += len(name)
            continue
        inside = {"[": True, "]": False}.get(pattern[at], inside)
        out.append(pattern[at])
        at += 1
    return re.compile("".join(out))


class Transducer:
    def __init__(self, ranks: dict[bytes, int], limit: int = 1_000_000):
        self.ranks, self.limit = ranks, limit
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.bytes_of = {i: b for b, i in ranks.items()}
        for b, i in ranks.items():
            ids, self.halves[i] = self._merge(b)
            if ids == [i]:
                node = 0
                for x in b:
                    key = node << 8 | x
                    if key not in self.child:
                        self.child[key] = len(self.token)
                        self.token.append(-1)
                    node = self.child[key]
                self.token[node] = i
        self._reset()

    def _reset(self) -> None:
        #: Guesses of a state: (tokens not yet sure, node, last token); the first is the one whose last token just ended.
        self.states: list[tuple] = [(((), 0, -1),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _merge(self, b: bytes) -> tuple[list[int], tuple[int, int]]:
        """Merging by rank, for short strings (what defines the machine): the ids, and the two that were merged last."""
        parts, last = [b[i : i + 1] for i in range(len(b))], (-1, -1)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], MANY), i) for i in range(len(parts) - 1))
            if rank == MANY:
                break
            last = self.ranks[parts[at]], self.ranks[parts[at + 1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts], last

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between two tokens.

        The merges inside both are undone from the latest to the earliest; at every stage the two pieces at the border must
        not have been due before the merge that was undone last.
        """
        if a < 0:
            return True
        known = self.pairs.get(a << 20 | b)
        if known is not None:
            return known
        key, due, known = a << 20 | b, MANY, True
        bytes_of, halves, ranks = self.bytes_of, self.halves, self.ranks
        while True:
            if ranks.get(bytes_of[a] + bytes_of[b], MANY) < due:
                known = False
                break
            left, right = halves[a][1], halves[b][0]
            if left >= 0 and (right < 0 or a > b):
                due, a = a, left  # of equal ranks the one further left goes first
            elif right >= 0:
                due, b = b + 1, right
            else:
                break
        if len(self.pairs) >= self.limit:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        alive, sures, ended, child, token = [], [], None, self.child.get, self.token
        for sure, node, last in self.states[state]:
            nxt = child(node << 8 | byte)
            if nxt is None:
                continue
            alive.append((sure, nxt, last))
            sures.append(sure)
            if ended is None:
                t = token[nxt]
                if t >= 0 and self._neighbours(last, t):
                    ended = (*sure, t)
        if not alive:
            common = len(ended)
        else:  # what the least and the greatest begin with, all begin with
            low, high, common = min(sures), max(sures), 0
            low, high = min(low, ended), max(high, ended)
            for x, y in zip(low, high, strict=False):
                if x != y:
                    break
                common += 1
        if common:
            key = ((ended[common:], 0, ended[-1]), *[(sure[common:], node, last) for sure, node, last in alive])
        else:
            key = ((ended, 0, ended[-1]), *alive)
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = out = (target, ended[:common])
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) > self.limit:
            self._reset()
        ids: list[int] = []
        state, moves = 0, self.moves
        for x in piece:
            step = moves.get(state << 8 | x)
            if step is None:
                step = self._move(state, x)
                if len(moves) > 3 * self.limit // 2:  # one very long pre-token: go on from a fresh table
                    here = self.states[step[0]]
                    self._reset()
                    moves = self.moves
                    state = self.number.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                    ids.extend(step[1])
                    continue
            state = step[0]
            if step[1]:
                ids.extend(step[1])
        ids.extend(self.states[state][0][0])
        return ids


class Encoder(dict):
    """Pre-token -> its ids as little-endian 32-bit words; ``encode`` joins those of a text."""

    def __init__(self, ranks_path: str, pattern: str, limit: int = 500_000):
        super().__init__()
        self.machine = Transducer(load_ranks(ranks_path))
        self.findall = compile_pattern(pattern).findall
        self.limit, self.older = limit, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:  # what was not used again by the next time goes
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            found = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.findall(text)))


# Well-formed UTF-8 (lead bytes; then the allowed range of the next byte and how many plain ones follow).
WELL_FORMED = [
    (0x00, 0x7F, None, 0), (0xC2, 0xDF, (0x80, 0xBF), 0), (0xE0, 0xE0, (0xA0, 0xBF), 1), (0xE1, 0xEC, (0x80, 0xBF), 1), (0xED, 0xED, (0x80, 0x9F), 1),
    (0xEE, 0xEF, (0x80, 0xBF), 1), (0xF0, 0xF0, (0x90, 0xBF), 2), (0xF1, 0xF3, (0x80, 0xBF), 2), (0xF4, 0xF4, (0x80, 0x8F), 2),
]
START, BAD = 0, -1


class StreamDecoder:
    """Ids in, text out; a character is given out when its last byte has come."""

    def __init__(self, vocabulary: dict[int, bytes]):
        self.vocabulary = vocabulary
        self.kinds: list[tuple[int, int, int]] = [(0, 0, 0)]  # of a state: the next byte's range, plain bytes after it
        self.lead: dict[int, int] = {}
        for lo, hi, nxt, more in WELL_FORMED:
            state = START if nxt is None else self._state(nxt[0], nxt[1], more)
            self.lead |= dict.fromkeys(range(lo, hi + 1), state)
        self.known: dict[tuple[int, int], int] = {}
        self.state, self.held = START, b""
        size = max(vocabulary, default=0) + 1
        self.plain = np.array([b in vocabulary and self.after(START, b) == START for b in range(size)])

    def _state(self, lo: int, hi: int, more: int) -> int:
        if (lo, hi, more) not in self.kinds[1:]:
            self.kinds.append((lo, hi, more))
        return self.kinds.index((lo, hi, more), 1)

    def step(self, state: int, byte: int) -> int:
        if state == START or state == BAD:
            return self.lead.get(byte, BAD)
        lo, hi, more = self.kinds[state]
        if not lo <= byte <= hi:
            return BAD
        return self._state(0x80, 0xBF, more - 1) if more else START

    def after(self, state: int, token: int) -> int:
        got = self.known.get((state, token))
        if got is None:
            got = state
            for x in self.vocabulary[token]:
                got = self.step(got, x)
            self.known[state, token] = got
        return got

    def feed(self, ids: np.ndarray) -> str:
        """The text that these ids complete."""
        data = self.held + b"".join(map(self.vocabulary.__getitem__, ids.tolist()))
        at = 0
        odd = np.flatnonzero(~self.plain[ids])
        if self.state != START:
            odd = np.unique(np.append(odd, 0))[: len(ids)] if len(ids) else odd
        while len(odd):
            at = max(at, int(odd[0]))
            while at < len(ids):
                self.state = self.after(self.state, int(ids[at]))
                at += 1
                if self.state == START:
                    break
            odd = odd[odd >= at]
        keep = 0
        if self.state not in (START, BAD):  # the last character's bytes so far
            keep = next(n for n in range(1, 4) if data[-n] >= 0xC0)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.state, self.held = self.held.decode("utf-8", "replace"), START, b""
        return rest


_machines: dict[tuple[str, str], tuple[Encoder, StreamDecoder]] = {}


def machines(ranks_path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """The worker's machines, kept from task to task."""
    if (ranks_path, pattern) not in _machines:
        e = Encoder(ranks_path, pattern)
        _machines[ranks_path, pattern] = e, StreamDecoder(e.machine.bytes_of)
    return _machines[ranks_path, pattern]


def decode(decoder: StreamDecoder, ids: np.ndarray, chunk: int = 4096) -> Iterable[str]:
    for at in range(0, len(ids), chunk):
        yield decoder.feed(ids[at : at + chunk])
    yield decoder.finish()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_tokens, ids_sha256, and decoded_sha256 of what the streaming decoder makes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = machines(ranks_path, pattern)
        for b in batches:
            rows = []
            with without_collector():
                for at in range(0, b.num_rows, 64):
                    for t in b.column(1).slice(at, 64).to_pylist():
                        raw = encoder.encode(t or "")
                        out = hashlib.sha256()
                        for text in decode(decoder, np.frombuffer(raw, "<u4")):
                            out.update(text.encode())
                        rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), out.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs, i, t = plain(docs, id_col, text_col)
    src = docs.select(F.col(i).alias("id"), F.col(t).cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
