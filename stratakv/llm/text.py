"""Vectorised text work inside tasks: words, and hashes of any run of symbols in constant time.

A prefix hash sums v[i] * P**i over symbols modulo 2**64 (P odd). The hash of symbols a..b-1 is then
(H[b] - H[a]) * P**-a, put through a 64-bit finaliser. Two independent families make 128 bits where equality
of hashes stands for equality of symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once in a task; a longer text is one piece. Work that holds many numbers for each
#: byte takes small pieces, whose arrays also stay in the processor's cache.
PIECE, SMALL = 2 << 20, 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Family:
    """One random base with its powers and inverse powers, and random values for bytes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1, 2**63)) * 8 + 5 & 2**64 - 1
        self.byte = rng.integers(1, 2**64, 256, dtype=np.uint64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up = self._powers(self.base, size)
            self.down = self._powers(pow(self.base, -1, 2**64), size)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        h = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=h[1:])
        return h

    def of_bytes(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(self.byte[data])

    def span(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self._grow(len(h))
        return mix64((h[b] - h[a]) * self.down[a])

    def grams(self, h: np.ndarray, k: int) -> np.ndarray:
        """A hash of every k consecutive symbols, not finalised: its upper bits depend on all of them."""
        self._grow(len(h))
        return (h[k:] - h[:-k]) * self.down[: len(h) - k]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is the empty text."""
    a = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes, or one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words begin in these."""
    w = ~spaces[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = off[1:] > off[:-1]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a], last[b] = w[a], w[b]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with bytes and offsets of their texts."""
    for batch in batches:
        data, off = utf8(batch.column(column))
        for lo, hi in pieces(off, limit):
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the same for the next start."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)
