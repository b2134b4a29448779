"""Vectorised scanning of whole texts inside tasks: words and word shingles as 64-bit hashes.

Works on the UTF-8 bytes of an Arrow batch, in blocks of a bounded number of
bytes (a longer document forms a block of its own). Words are runs of bytes
other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1


@cache
def _tables():
    rng = np.random.default_rng(20240501)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in range(65, 91):
        value[b] = value[b + 32]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    bare = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
    return value, space, bare


_powers: dict = {}


def _power_arrays(n: int):
    """P^0..P^(n-1) and the powers of P's inverse, modulo 2^64."""
    if _powers.get("n", 0) < n:
        n = max(n, BLOCK_BYTES + 4096)
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            out = np.empty(n, np.uint64)
            out[0], have, factor = 1, 1, base
            while have < n:
                m = min(have, n - have)
                out[have:have + m] = out[:m] * np.uint64(factor)
                have, factor = have + m, factor * factor % (1 << 64)
            _powers[name] = out
        _powers["n"] = n
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of the rows first..last-1 of a batch."""
    first: int
    last: int
    data: np.ndarray        # the bytes of these rows
    doc_off: np.ndarray     # byte offset of each row in data, and the end
    start: np.ndarray       # byte offset of each word
    end: np.ndarray
    hash: np.ndarray        # uint64 of each word, A-Z lower-cased
    word_off: np.ndarray    # index of each row's first word, and the end


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, block_bytes: int = BLOCK_BYTES):
    """(first row, last row) of blocks of at most block_bytes, or of one row."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def scan_words(data: np.ndarray, doc_off: np.ndarray, first: int = 0, letters_only: bool = False) -> Words:
    """letters_only: all ASCII characters but letters and digits separate words."""
    value, space, bare = _tables()
    if letters_only:
        space = bare
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(first, first + len(doc_off) - 1, data, doc_off, z, z, z.astype(np.uint64),
                     np.zeros(len(doc_off), np.int64))
    p, q = _power_arrays(n + 1)
    word = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[doc_off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * p[:n], out=total[1:])
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
    return Words(first, first + len(doc_off) - 1, data, doc_off, start, end, h,
                 np.searchsorted(start, doc_off).astype(np.int64))


def batch_words(column, block_bytes: int = BLOCK_BYTES, letters_only: bool = False):
    """Words of an Arrow string column, block by block."""
    data, off = text_bytes(column)
    for i, j in blocks(off, block_bytes):
        yield scan_words(data[off[i]:off[j]], off[i:j + 1] - off[i], i, letters_only)


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash that scan_words gives each of these words."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return scan_words(data, np.array([0, len(data)], np.int64)).hash


def shingle_sets(words: Words, k: int = 5):
    """For each row the sorted distinct hashes of its k-word shingles.

    Fewer than k words form one shingle, the whole sequence; no words, none.
    """
    h, off = words.hash, words.word_off
    width = max(0, len(h) - k + 1)
    s = np.zeros(width, np.uint64)
    for i in range(k):
        s = mix(s * np.uint64(_P) + h[i:i + width])
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= k:
            yield np.unique(s[a:b - k + 1])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for i in range(a, b):
                x = mix(x * np.uint64(_P) + h[i:i + 1] + np.uint64(17))
            yield x
        else:
            yield np.zeros(0, np.uint64)
