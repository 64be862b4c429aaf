"""Vectorised tokenising of Arrow text columns.

Words are maximal runs of bytes outside {0x20, 0x09-0x0D}. Everything below works on the UTF-8 bytes of a slice of a
record batch, so no Python object is made per word. Hashes are 64-bit: a word's hash is a polynomial over random byte
codes, a window's hash a polynomial over word hashes, both finished by a mixer.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[65:91] = _CODE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            cls.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _BASE))])
            cls.down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _BASE_INV))])
        return cls.up, cls.down


def released() -> None:
    """Gives memory that is free in this process back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the column's text in each piece stays near ``limit`` bytes (one text at least)."""
    lengths = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(lengths), 0), dtype=np.int64)
    total, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """Words of a slice: byte ranges, and the first word of each text (with one more entry at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if n == 0 or texts.buffers()[2] is None:
            data, offsets = np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
        else:
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
        word = ~_SPACE[data]
        opens, closes = word.copy(), word.copy()
        if len(data):
            opens[1:] &= ~word[:-1]
            closes[:-1] &= ~word[1:]
            inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
            opens[inner] = word[inner]
            closes[inner - 1] = word[inner - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return cls(data, offsets, start, end, np.searchsorted(start, offsets))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of byte ranges."""
        up, down = _Powers.upto(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_CODE_LOWER if lower else _CODE)[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.spans(self.start, self.end, lower)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the number of bytes whose value has the flag."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags[self.data], out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_chars(self) -> np.ndarray:
        return self.sums(_LEAD & ~_SPACE)

    def text(self, i: int, a: int, b: int) -> bytes:
        """Bytes from word a to word b (exclusive) of text i."""
        k = self.first[i]
        return self.data[self.start[k + a] : self.end[k + b - 1]].tobytes() if b > a else b""


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and the place of each run's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[width - 1 : width - 1 + n].copy()
    for j in range(width - 2, -1, -1):
        total *= _STEP
        total += hashes[j : j + n]
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(room >= width)
    return mix(total[at]), at


def long_windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(), at a cost that does not depend on the width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _Powers.upto(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(room >= width)
    return mix((total[at + width] - total[at]) * down[at]), at
