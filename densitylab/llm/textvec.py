"""Vectorised words, word hashes and word n-grams of Arrow string batches.

A batch of texts is looked at as one byte buffer.  A 256-entry table folds
A-Z and marks separators, so word borders come from two shifted comparisons
and the hash of each word from one running polynomial sum.  No Python object
is made for a word.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
#: Another base, for a second hash that agrees by chance no more often than the first.
OTHER = np.uint64(0xA0761D6478BD642F)
_TAB = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _alnum_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    sep = np.zeros(256, bool)
    sep[:0x30] = sep[0x3A:0x41] = sep[0x5B:0x61] = sep[0x7B:0x80] = True
    t[sep] = 0
    return t


def _space_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = 0
    return t


#: Words of digits, folded ASCII letters and every non-ASCII character.
ALNUM = _alnum_table()
#: Words are runs of anything but ASCII white space (byte 0 is kept apart below).
SPACE = _space_table()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.p = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.p) < n:
            steps = np.full(max(n, CHUNK_BYTES + 1), self.base, np.uint64)
            steps[0] = 1
            p = np.cumprod(steps, dtype=np.uint64)
            if n > 4 * CHUNK_BYTES:
                return p  # too large to hold on to
            self.p = p
        return self.p[:n]


_POW, _IPOW = _Powers(_P), _Powers(_P_INV)


@dataclass
class Words:
    """Words of the documents ``first .. first + len(ptr) - 2`` of a batch.

    ``data[start[i]:end[i]]`` are the folded bytes of word i; document d has
    the words ``ptr[d] .. ptr[d + 1] - 1``.
    """

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.ptr) - 1

    def beginnings(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word."""
        run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TAB[self.data] * _POW.upto(len(self.data)), out=run[1:])
        end = np.minimum(self.end, self.start + size)
        return mix64((run[end] - run[self.start]) * _IPOW.upto(len(self.data))[self.start] + (end - self.start).astype(np.uint64)) if len(self.start) else self.hash

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.ptr))

    def grams(self, k: int, salt: int = 0, base: np.uint64 = _GRAM) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one document."""
        n = len(self.hash)
        m = max(0, n - k + 1)
        ok = np.zeros(n, bool)
        out = np.full(n, np.uint64(salt))
        if m:
            acc = np.full(m, np.uint64(salt + k))
            for j in range(k):
                acc = acc * base + self.hash[j : j + m]
            out[:m] = mix64(acc)
            ends = np.repeat(self.ptr[1:], np.diff(self.ptr))
            ok[:m] = np.arange(m) + k <= ends[:m]
        return out, ok


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(texts: pa.Array, table: np.ndarray = ALNUM, hashes: bool = True, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    raw, offsets = buffers(texts)
    for lo, hi in spans(offsets, limit):
        part = raw[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        folded = table[part]
        word = folded != 0
        if table is SPACE:
            word |= part == 0
        n = len(part)
        inside = np.zeros(n + 1, bool)  # the byte before is a word's byte of the same document
        inside[1:] = word
        inside[at] = False
        start = np.flatnonzero(word & ~inside[:n])
        follows = np.zeros(n + 1, bool)
        follows[:n] = word
        follows[at] = False
        end = np.flatnonzero(word & ~follows[1:]) + 1
        h = np.zeros(0, np.uint64)
        if hashes:
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(_TAB[folded] * _POW.upto(n), out=run[1:])
            h = mix64((run[end] - run[start]) * _IPOW.upto(n)[start] + (end - start).astype(np.uint64)) if n else h
        yield Words(lo, folded, start, end, h, np.searchsorted(start, at).astype(np.int64), at)
