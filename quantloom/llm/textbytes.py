"""Vectorised byte-level word splitting and hashing over Arrow string arrays.

Words are found on the UTF-8 bytes of whole texts; all arithmetic is numpy on
slices of about a megabyte, so memory does not depend on the batch size (one very
long text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(n, _BASE, U64)
    down = np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """Words of a slice of texts: ``start``/``end`` index ``data`` (lower-cased bytes);
    words of text i are ``ptr[i]:ptr[i+1]``."""

    def __init__(self, texts: pa.Array, table: np.ndarray, lower: bool = True):
        data, offsets = raw(texts)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = table[self.data]
        n = len(inside)
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | fresh[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        self.ptr = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over the bytes, then mixed."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, U64)
        up, down = _powers(max(20, int(n).bit_length()))
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        value = (total[self.end] - total[self.start]) * down[self.start]
        return mix(value ^ ((self.end - self.start).astype(U64) * U64(0xA0761D6478BD642F)))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
