"""Hashed bags of words over Arrow arrays: the feature indices of the ML hashing transformer, many words at a time."""

from __future__ import annotations

import numpy as np

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
SEED = 42


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def murmur3(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Murmur3 of 32 bits, as signed integers, of the bytes ``data[starts[i]:ends[i]]``."""
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.uint32)
    size = ends - starts
    h = np.full(len(starts), seed, np.uint32)
    # Longest first, so the words with four bytes left are always in front.
    order = np.argsort(-size, kind="stable")
    at, left, n = starts[order], size[order], len(size)
    while n := int(np.searchsorted(-left[:n], -4, side="right")):
        p = at[:n]
        k = padded[p] | padded[p + 1] << np.uint32(8) | padded[p + 2] << np.uint32(16) | padded[p + 3] << np.uint32(24)
        k = _rotated(k * _C1, 15) * _C2
        h[:n] = _rotated(h[:n] ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        at[:n] += 4
        left[:n] -= 4
    tail = np.zeros(len(left), np.uint32)
    for i in range(3):
        tail |= np.where(left > i, padded[np.minimum(at + i, len(padded) - 1)], np.uint32(0)) << np.uint32(8 * i)
    mixed = np.where(left > 0, h ^ (_rotated(tail * _C1, 15) * _C2), h)
    mixed = mixed ^ size[order].astype(np.uint32)
    mixed = (mixed ^ mixed >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    mixed = (mixed ^ mixed >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(16)
    out = np.empty(len(mixed), np.uint32)
    out[order] = mixed
    return out.view(np.int32)
