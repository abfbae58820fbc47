"""Vectorised words, hashes and minima over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random odd number a byte value; white space counts nothing in a word's sum.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = np.where(SPACE, np.uint64(0), BYTE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the power 0..n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 4096), BASE, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(off: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(buf: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs free of white space), their first bytes, and each row's bounds among them."""
    if lower:
        buf = LOWER[buf]
    ns = ~SPACE[buf]
    at = ns.copy()
    at[1:] &= ~ns[:-1]
    heads = off[:-1][off[1:] > off[:-1]]
    at[heads] = ns[heads]
    starts = np.flatnonzero(at)
    bounds = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, bounds
    first = starts[0]
    lens = np.diff(np.append(starts, len(buf)))
    k = np.arange(len(buf) - first) - np.repeat(starts - first, lens)
    sums = np.add.reduceat(WORD_BYTE[buf[first:]] * powers(int(lens.max()))[k], starts - first)
    return mix(sums), starts, bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each row; all words as one if there are fewer."""
    if len(hashes) >= k:
        n = len(hashes) - k + 1
        all_ = hashes[:n].copy()
        for j in range(1, k):
            all_ = mix(all_ * BASE + hashes[j : j + n])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_[a : b - k + 1]))
        elif b > a:
            short = hashes[a : a + 1].copy()
            for j in range(a + 1, b):
                short = mix(short * BASE + hashes[j : j + 1])
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """Mixed hashes of all windows of ``width`` bytes, a power of two, by doubling."""
    h, have = BYTE[buf], 1
    while have < width:
        n = len(h) - have
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = h[:n] * powers(width + 1)[have] + h[have:]
        have *= 2
    return mix(h)


def sliding(v: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each window of ``width`` values, by doubling."""
    have = 1
    want = len(v) - width + 1
    while have * 2 <= width:
        v = op(v[:-have], v[have:])
        have *= 2
    return op(v[:want], v[width - have : width - have + want])
