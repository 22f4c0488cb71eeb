"""Word shingles of whole texts as sorted arrays of 64-bit hashes, by array operations on the bytes."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 3)


class Powers:
    """Powers of an odd step and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = np.ones(1, U)
        self.down = np.ones(1, U)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            self.up = np.concatenate(([U(1)], np.cumprod(np.full(size - 1, _STEP, U))))
            self.down = np.concatenate(([U(1)], np.cumprod(np.full(size - 1, _BACK, U))))


_powers = Powers()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of A-Z lower-cased UTF-8: a polynomial over random byte values, scrambled."""
    b = np.frombuffer(text.lower(), np.uint8)
    if not len(b):
        return np.empty(0, U)
    _powers.to(len(b) + 1)
    inside = np.concatenate(([False], ~_SPACE[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, U)
    total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[b] * _powers.up[: len(b)])))
    return mix((total[end] - total[start]) * _powers.down[start] + (end - start).astype(U), 5)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` successive words (ASCII white space, A-Z lower-cased); of all words if they are fewer."""
    codes = word_hashes(text or b"")
    if not len(codes):
        return codes
    take = min(width, len(codes))
    acc = codes[: len(codes) - take + 1].copy()
    for j in range(1, take):
        acc = mix(acc, j) + codes[j : len(codes) - take + 1 + j]
    return np.unique(mix(acc, 64 + take))


#: Low bits of a signature that hold the bit length of the set's size.
SIZE_CLASS = 5


def set_signature(s: np.ndarray) -> int:
    """64 bits that stand for the whole set, signed for Spark; 2 to the low SIZE_CLASS bits is more than the set's size."""
    h = xxhash.xxh3_64_intdigest(s.tobytes()) >> SIZE_CLASS << SIZE_CLASS | len(s).bit_length()
    return h - (1 << 64) if h >= 1 << 63 else h
