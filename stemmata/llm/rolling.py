"""Polynomial hashes of byte spans, and sliding minima, over whole arrays at once."""

from __future__ import annotations

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_tables: dict[int, np.ndarray] = {}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_bytes(kind: int) -> np.ndarray:
    if kind not in _tables:
        _tables[kind] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD[kind]))
    return _tables[kind]


def _power(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2 ** 64, and of its inverse."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        base = _ODD[kind] | 1
        size = max(n, 1 << 16)
        _powers[kind] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[kind]


class SpanHash:
    """Hashes of spans of a byte array; equal bytes have equal hashes wherever they stand. kind: one of two independent hashes."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        forth, self.back = _power(kind, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_of_bytes(kind)[data] * forth[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(_ODD[0]))

    def all(self, size: int) -> np.ndarray:
        """Hashes of the spans of `size` bytes at each place."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


class RowHash(SpanHash):
    """Hashes of spans of an array of 64-bit hashes."""

    def __init__(self, values: np.ndarray):
        forth, self.back = _power(0, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed(values) * forth[: len(values)], out=self.sums[1:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    if len(x) < width:
        return x[:0]
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it that is smaller, or -1: all entries follow their pointers at once."""
    near = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo := todo[(near[todo] >= 0)]) and len(todo := todo[values[near[todo]] > values[todo]]):
        near[todo] = near[near[todo]]
    return near
