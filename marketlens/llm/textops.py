"""Words, hashes and windows of many texts at once, in numpy, and exchanges of sorted hashes between groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: White space of a word boundary: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
BASE, WORD_BASE = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
#: A random odd-free image of each byte, by a rule.
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


IMAGE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n and their inverses, modulo 2^64."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) <= n:
        size = max(1 << 20, 1 << int(n + 1).bit_length())
        inverse = _U(pow(key, -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[key] = (both[0], both[1])
    return _powers[key]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans have equal hashes."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Texts:
    """Bytes of some texts, end to end."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Of a string or binary column; null counts as empty."""
        if column.null_count:
            column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        buffers = column.buffers()
        at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        return cls(data, at - at[0])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of each word, and the first word of each text, with the number of words last."""
        solid = ~SPACE[self.data]
        n = len(solid)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return start, end, np.searchsorted(start, self.at)


def chunks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most `most` bytes together, or one row."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            out.append((first, i))
            first, total = i, 0
        total += int(n)
    return [*out, (first, len(sizes))] if len(sizes) else []


def windows(counts_at: np.ndarray, size: int) -> np.ndarray:
    """Positions where a window of `size` lies within its text; counts_at: the first position of each text, and the end."""
    n = int(counts_at[-1])
    ok = np.zeros(n + 1, np.int32)
    full = np.diff(counts_at) >= size
    first, last = counts_at[:-1][full], counts_at[1:][full] - size + 1
    np.add.at(ok, first, 1)
    np.add.at(ok, last, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def covered(n: int, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the runs that begin at `start`."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + size, -1)
    return np.cumsum(mark[:-1]) > 0


def pack_sorted(x: np.ndarray, width: int = 8) -> bytes:
    """Sorted 64-bit numbers as differences, a plane a byte: the high planes are zeros, which a shuffle's codec removes."""
    d = np.diff(x, prepend=_U(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unpack_sorted(blob: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :width] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, a plane a byte."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()
