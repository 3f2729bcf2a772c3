"""Hashes of word sequences, computed for a whole text at once inside a task."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019), np.uint64(0xBF58476D1CE4E5B9)
_29, _32 = np.uint64(29), np.uint64(32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence ``a`` then ``b``, element by element."""
    x = (a * _A) ^ (b + _B)
    x ^= x >> _29
    x *= _C
    x ^= x >> _32
    return x


def windows(ones: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` elements, built by doubling."""
    n = len(ones) - length + 1
    if n <= 0:
        return ones[:0]
    out, have, power, size = None, 0, ones, 1
    while True:
        if length & size:
            part = power[have : have + n]
            out = part if out is None else pair_hash(out[:n], part)
            have += size
        if have == length:
            return out[:n].copy()
        power, size = pair_hash(power[:-size], power[size:]), size * 2


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Smallest (or largest) value of every ``width`` consecutive ones, in log steps."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values, size = best(values[:-size], values[size:]), size * 2
    return best(values[:n], values[width - size : width - size + n])


def signed(a: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return a.view(np.int64)
