"""Words and rolling hashes of whole Arrow columns of text, in numpy.

A word is a maximal run of ASCII letters, digits and bytes from 0x80 (all of non-ASCII UTF-8), after lower-casing. Its
hash is a polynomial over its bytes modulo 2**64, read off one cumulative sum over the buffer (the base is odd, so it
has an inverse), then mixed. No step runs once a row or once a word in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _WBASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_IS_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (97, 123), (65, 91), (128, 256)):
    _IS_WORD[_a:_b] = True
_VALUE = (np.arange(256, dtype=U) + U(1)) * U(0xC2B2AE3D27D4EB4F)
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64."""
    h = h + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _kept or len(_kept[base][0]) < n:
        n = max(n, 1 << 16) * 5 // 4
        out = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(n, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _kept[base] = (out[0], out[1])
    return _kept[base]


class Words:
    """Of a column of n texts: hash of each word, in order; first[i]:first[i + 1] are the words of text i."""

    def __init__(self, texts: pa.Array, lower: bool = True, seed: int = 0):
        self.seed = seed  # other seeds give other hashes: the bases stay odd
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.utf8_lower(texts)
        n = len(texts)
        _, off, data = texts.buffers()
        off = np.frombuffer(off, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        self.raw, self.offsets = raw, off
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = _IS_WORD[raw]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        inner = off[1:-1]
        starts[inner] = inside[inner]  # a text begins a new word even where the one before it ended inside one
        self.start = np.flatnonzero(starts)
        ends = ~inside
        ends[1:] &= inside[:-1]
        ends[0] = False
        inner = inner[inner > 0]
        ends[inner] = inside[inner - 1]
        self.end = np.flatnonzero(ends)
        up, down = powers(_BASE ^ (seed << 16), len(raw) + 1)
        total = np.zeros(len(raw) + 1, U)
        np.cumsum(_VALUE[raw] * down[: len(raw)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * up[self.start])
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are all in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, U), np.zeros(n, bool)
        up, down = powers(_WBASE ^ (self.seed << 16), n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hash * down[:n], out=total[1:])
        out = np.zeros(n, U)
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * up[: n - k + 1], k)
        return out, np.arange(n) + k <= np.repeat(self.first[1:], self.count)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i:i + w] for each i (shorter by w - 1), by doubling."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)
