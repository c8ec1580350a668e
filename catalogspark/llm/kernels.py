"""Vectorised text kernels for use inside Arrow tasks: words, word hashes and n-gram sets of many texts at once.

A chunk is a run of texts of at most ``CHUNK_BYTES`` (or one longer text), so memory follows the longest text and
not the batch. Words are hashed by differences of one running sum: with ``S[i] = sum(T[b[j]] * B**j, j < i)`` modulo
2**64 the hash of bytes ``s..e`` is ``(S[e] - S[s]) * B**-s``, whatever stands before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: White space between words: blank and the five controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits; bytes of longer characters belong to words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK_BYTES + 1)
        one = np.ones(1, _U)
        _powers = np.concatenate([one, np.cumprod(np.full(n - 1, _BASE, _U))])
        _inverses = np.concatenate([one, np.cumprod(np.full(n - 1, _BASE_INVERSE, _U))])
    return _powers, _inverses


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each row in the bytes and their end). Null texts count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a chunk: byte spans ``start``/``end``, 64-bit ``hash``; words of row ``d`` are ``first[d]:first[d+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        low = _LOWER[data]
        n = len(low)
        inside = ~gaps[low]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        edge[n] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.low = low
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        powers, inverses = _powers_to(n + 1)
        self._total, self._inverses = np.zeros(n + 1, _U), inverses
        np.cumsum(_BYTE_VALUES[low] * powers[:n], out=self._total[1:])
        self.hash = self._hash(self.start, self.end)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._total[end] - self._total[start]) * self._inverses[start] ^ (end - start).astype(_U))

    def prefix_hash(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the words longer than ``n`` bytes, hashes of their first ``n`` bytes)."""
        long = np.flatnonzero(self.end - self.start > n)
        return long, mix(self._hash(self.start[long], self.start[long] + n) + _U(n))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _combine(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), _U)
    for part in parts:
        out = out * _U(0xD1342543DE82EF95) + part
    return mix(out + _U(len(parts)))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its n-word shingles; of a shorter text the whole sequence as one."""
    h, first = words.hash, words.first
    grams = _combine([h[k : len(h) - n + 1 + k] for k in range(n)]) if len(h) >= n else np.zeros(0, _U)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(_combine([h[k : k + 1] for k in range(a, b)]))
        else:
            out.append(np.zeros(0, _U))
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of the given arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
