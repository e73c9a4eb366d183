"""Vectorised text kernels over Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+`` taken on UTF-8 bytes: every byte of a multi-byte
character is above 0x7F, so splitting bytes and splitting code points agree.
All kernels work on slices of a few MB, so memory does not follow batch size;
one very long text is hashed block by block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_S30, _S27, _S31 = U64(30), U64(27), U64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (splitmix)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base mod 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), None, None

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None or len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out, filled, step = np.ones(size, U64), 1, base % (1 << 64)
        while filled < size:
            m = min(filled, size - filled)
            out[filled : filled + m] = out[:m] * U64(step)
            filled, step = filled + m, step * step % (1 << 64)
        return out


_IN_WORD, _IN_WINDOW = Powers(0x9E6C63D0676A9A99), Powers(0xD1342543DE82EF95)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about the same bytes of text each, ``limit`` at most but for a single row."""
    _, offsets = text_buffers(batch.column(column))
    limit = min(limit, -(-int(offsets[-1]) // -(-int(offsets[-1]) // limit)) + 4096) if offsets[-1] else limit
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 word offsets of the texts."""
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = inside[cuts]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words wherever they stand."""
    out, lo, n = np.empty(len(starts), U64), 0, len(starts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK_BYTES, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _IN_WORD.get(b - a + 1)
        run = np.zeros(b - a + 1, U64)
        np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=run[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (run[e] - run[s]) * down[s] + (e - s).astype(U64) * _M2
        lo = hi
    return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def window_hashes(words: np.ndarray, size: int, block: int = 1 << 18) -> np.ndarray:
    """Rabin-Karp hash of each run of ``size`` words; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for lo in range(0, n, block):
        m = min(block, n - lo)
        up, down = _IN_WINDOW.get(m + size)
        run = np.zeros(m + size, U64)
        np.cumsum(words[lo : lo + m + size - 1] * up[: m + size - 1], out=run[1:])
        out[lo : lo + m] = (run[size : size + m] - run[:m]) * down[:m]
    return mix(out)


def windows_of_texts(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions (in ``words``) of the windows that stay inside one text."""
    h = window_hashes(words, size)
    if not len(h):
        return h, np.zeros(0, np.int64)
    ok = np.zeros(len(words) + 1, np.int32)
    full = offsets[1:] - offsets[:-1] >= size
    np.add.at(ok, offsets[:-1][full], 1)
    np.add.at(ok, offsets[1:][full] - size + 1, -1)
    at = np.flatnonzero(np.cumsum(ok[:-1])[: len(h)] > 0)
    return h[at], at


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def release() -> None:
    """Give freed memory back to the system: Python workers are reused, and what one task needed would count for all after it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


_MODEL: dict = {}


def model(key: Hashable, make: Callable):
    """What ``make`` gives, made once in each Python process while the same is asked for. Workers are reused by all operators: one
    that asks for another model lets go of the last, so that a worker holds one at most."""
    if key not in _MODEL:
        _MODEL.clear()
        release()
        _MODEL[key] = make()
        release()
    return _MODEL[key]


def planes(values: np.ndarray, kind) -> bytes:
    """Numbers as bytes, all lowest bytes first: the planes of small numbers' high bytes are zeros, which a shuffle compresses away."""
    values = np.ascontiguousarray(values, kind)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()
