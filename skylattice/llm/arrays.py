"""Numpy kernels over Arrow text columns, used inside ``mapInArrow`` tasks.

A *slice* is a run of whole documents laid end to end: ``data`` (uint8) and ``off`` (one more entry than
documents). Kernels work on the slice at once and never let a word or window cross a document boundary.
Hash arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random odd value of each byte; fixed by the seed so that every executor hashes alike.
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z mapped to a-z.
BYTE_VALUE_LOWER = BYTE_VALUE.copy()
BYTE_VALUE_LOWER[65:91] = BYTE_VALUE[97:123]
BASE = np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _grown(table: np.ndarray, step: np.uint64, n: int) -> np.ndarray:
    while len(table) < n:
        with np.errstate(over="ignore"):
            table = np.concatenate([table, table * (table[-1] * step)])
    return table


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1)."""
    global _powers
    _powers = _grown(_powers, BASE, n)
    return _powers[:n]


def inverse_powers(n: int) -> np.ndarray:
    global _inverses
    _inverses = _grown(_inverses, BASE_INVERSE, n)
    return _inverses[:n]


def release() -> None:
    """Hands freed memory back: a worker that waits for its next batch or task holds no freed arrays."""
    pa.default_memory_pool().release_unused()


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, data, off) of consecutive documents with about ``max_bytes`` bytes, one document at least and ``max_rows`` at most; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = hi if max_rows is None else min(hi, lo + max_rows)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    release()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice, or runs of the bytes ``inside``: byte spans, and words before each document in ``off``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None):
        inside = ~IS_SPACE[data] if inside is None else inside
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = off[:-1][off[:-1] < off[1:]]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, off)
        self.data, self.inside = data, inside

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z lowered on demand."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        a = self.start[0]
        value = (BYTE_VALUE_LOWER if lower else BYTE_VALUE)[self.data[a:]]
        value[~self.inside[a:]] = 0
        lens = np.diff(np.append(self.start, len(self.data)))
        at = np.arange(len(value)) - np.repeat(self.start - a, lens)
        value *= powers(int(lens.max()))[at]
        return mix(np.add.reduceat(value, self.start - a) + (self.end - self.start).astype(np.uint64))


def kgrams(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of units[i:i+k] for each i; built from hashes of half the length. Empty if there are fewer than k."""
    if len(units) < k:
        return np.zeros(0, np.uint64)
    h, n = units, 1
    with np.errstate(over="ignore"):
        power = BASE
        for bit in bin(k)[3:]:
            h = h[:-n] * power + h[n:]
            power, n = power * power, 2 * n
            if bit == "1":
                h = h[:-1] * BASE + units[n : n + len(h) - 1]
                power, n = power * BASE, n + 1
    return mix(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i:i+w]) for each i."""
    m, k = h, 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    r = w - k
    return np.minimum(m[: len(m) - r], m[r:]) if r else m


def span_hashes(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of units[start:end] for arbitrary spans, from one running sum."""
    n = len(units)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(units * powers(n), out=total[1:])
    return mix((total[end] - total[start]) * inverse_powers(n + 1)[start] + (end - start).astype(np.uint64))


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. count[0] values, then start[1], .."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before - start, count)


def list_array(values: pa.Array, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)
