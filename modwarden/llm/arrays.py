"""Vectorised text helpers for Arrow batches: UTF-8 buffers, words, hashes, group labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of one text column (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of non-space bytes, and the first word of each row (plus the total)."""
    space = _SPACE[data] if space is None else space
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    return starts, np.flatnonzero(after & ~space) + 1, np.searchsorted(starts, offsets)


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


class Rolling:
    """Sums ``x[i] * p**i`` whose differences are the polynomial hashes of any span; powers are kept."""

    def __init__(self, base: int = _P):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def spans(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(x) + 1:
            self.up, self.down = powers(self.base, len(x) + 1), powers(self.inverse, len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rolling: Rolling) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    return mix(rolling.spans(data.astype(np.uint64) + np.uint64(1), starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(_P_INV))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: the group of each element, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - first[group]


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum over each run ``first[i]:first[i+1]``; empty runs give zero."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.int64 if values.dtype.kind in "bui" else values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=out.dtype)
    return out


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes under the edges ``a - b``."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array with equal-weight bytes together, so that constant ones compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T).view(dtype).reshape(n)
