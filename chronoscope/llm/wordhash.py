"""Words of Arrow text columns as arrays of 64-bit fingerprints.

All work is done on the UTF-8 bytes of a whole batch, in pieces of bounded
size, so that neither the time nor the memory depends on Python objects per
word. A fingerprint takes up a word's bytes eight at a time, each time through
a mixing bijection; a long word's is BLAKE2. Two seeds give two independent
fingerprints: words that agree in one still differ in the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Lanes of eight bytes that a word's hash reads; longer words are hashed by BLAKE2.
LANES = 8
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)


@lru_cache
def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 7919 + 1))


@lru_cache
def is_word(kind: str) -> np.ndarray:
    """Bytes that belong to words: ``space`` takes all but white space, ``alnum`` ASCII letters, digits and all non-ASCII characters."""
    t = np.ones(256, bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:128] = False
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = True
    return t


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about ``limit`` bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and how many words lie before each row (n + 1 values)."""
    inside = is_word(kind)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, fold: bool = False) -> np.ndarray:
    """A fingerprint of each word; ``fold`` takes A to Z as a to z."""
    size = ends - starts
    h = mix((size.astype(U) + U(seed + 1)) * U(0x9E3779B97F4A7C15))
    if not len(size):
        return h
    if fold:
        data = _FOLD[data]
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    some = slice(None)
    for k in range(LANES):
        if k:
            some = np.flatnonzero(size > 8 * k)
            if not len(some):
                break
        x = lanes[starts[some] + 8 * k] & _LANE_MASK[np.minimum(size[some] - 8 * k, 8)]
        h[some] = mix(h[some] ^ x) + U(0x632BE59BD9B4E019 * (2 * seed + 1) % (1 << 64))
    for r in np.flatnonzero(size > 8 * LANES):
        word = data[starts[r] : ends[r]].tobytes()
        h[r] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A fingerprint of each ``k`` consecutive values, at the place of the first; windows that cross rows are the caller's to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = h[:n] + U(0x9E3779B97F4A7C15 + 1000003 * seed)
    for j in range(1, k):
        acc *= U(0xFF51AFD7ED558CCD)
        acc ^= acc >> U(29)
        acc += h[j : j + n]
    return mix(acc)


def row_of(counts: np.ndarray) -> np.ndarray:
    """For n + 1 cumulated counts, the row of each element."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))
