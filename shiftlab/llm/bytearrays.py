"""Numpy helpers over the bytes of a batch of texts: words, their hashes, slices.

A hash is a polynomial over a fixed random value per byte, modulo 2**64, with a
final mix.  Two different words or shingles share one with odds of about
2**-64 a pair; the operators that compare hashes say so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
WORD_CHAR = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD_CHAR[_a:_b + 1] = False


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up = np.full(n, BASE, U64)
    down = np.full(n, U64(pow(int(BASE), -1, 1 << 64)), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)


_table = np.zeros(0, U64), np.zeros(0, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (at least), modulo 2**64; the table is as large as the longest asked for."""
    global _table
    if n > len(_table[0]):
        _table = _powers(max(16, int(n).bit_length()))
    up, down = _table
    return up[:n], down[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_binary(column.type) else column
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges [i, j) of texts with about ``most`` bytes, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, word offsets of each text) of words, none across texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], inside[-1]
    edge[1:n] = inside[1:] != inside[:-1]
    # A text's border between two word bytes ends one word and begins another.
    border = np.unique(offsets[1:-1])
    border = border[(border > 0) & (border < n)]
    both = border[inside[border] & inside[border - 1]]
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(hash of each lower-cased word, word offsets of each text)."""
    data = LOWER[data]
    starts, ends, per_text = word_spans(data, offsets, is_word)
    return span_hashes(data, starts, ends), per_text


def texts_of(words_at: np.ndarray) -> np.ndarray:
    """The text's number of each word, from the word offsets of each text."""
    return np.repeat(np.arange(len(words_at) - 1), np.diff(words_at))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64, copy=False) if x.dtype != U64 else x.view(np.int64), pa.int64())
