"""Hashed n-gram features of many texts at once, as numpy arrays."""

from collections.abc import Iterable

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def pack(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, and where each text starts and ends."""
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), ends - sizes, ends


def bucket(values: np.ndarray, bits: int) -> np.ndarray:
    """Multiplicative hash of 64-bit values."""
    mixed = (values ^ (values >> np.uint64(29))) * _MIX
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def byte_grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes from each position on; the last n-1 positions have none."""
    count = len(data) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64)
    value = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        value = (value << np.uint64(8)) | data[i : i + count]
    return bucket(value, bits)


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word between white space, and which words belong to each text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    last = inside.copy()
    last[:-1] &= space[1:]
    cuts = starts[(starts < len(data)) & (starts < ends)]
    first[cuts] = inside[cuts]
    edges = cuts[cuts > 0] - 1
    last[edges] = inside[edges]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = np.full(len(data) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(data) + 1, _BASE_INVERSE, dtype=np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    hashes = (sums[stop] - sums[begin]) * inverse[begin]
    return hashes, np.searchsorted(begin, starts), np.searchsorted(begin, ends)


def means(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean of values[start:end] of each text, 0 where it is empty."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.minimum(np.maximum(ends, starts), len(values))
    starts = np.minimum(starts, len(values))
    count = np.maximum(ends - starts, 0)
    return (sums[np.maximum(ends, starts)] - sums[starts]) / np.maximum(count, 1)


def counted(values: Iterable[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for v in values:
        out += np.bincount(v, minlength=size)
    return out
