"""Distances of two profiles, as columns and as NumPy kernels over blocks of profiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(a: Column, b: Column, distance: Column) -> Column:
    unequal = F.raise_error(F.lit("Sequences must be of equal length")).cast("bigint")
    return F.when(F.size(a) != F.size(b), unequal).otherwise(distance)


def _count(a: Column, b: Column, costs: Callable[[Column, Column], Column]) -> Column:
    return _checked(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.when(costs(x, y), 1).otherwise(0)), F.lit(0).cast("bigint"), lambda s, x: s + x))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two profiles differ; missing alleles are symbols like others. Unequal lengths are an error."""
    return _count(a, b, lambda x, y: x != y)


def directional_hamming(u: Column, v: Column) -> Column:
    """Cost of going from u to v. At each place the first that holds counts: v missing and u not, 1; u missing and v not, 0; u > v, 1."""
    missing = lambda x: x.isin(-1, 0)
    return _count(u, v, lambda x, y: F.when(missing(y) & ~missing(x), True).when(missing(x) & ~missing(y), False).otherwise(x > y))


def directional_hamming_symbols(u: Column, v: Column) -> Column:
    """The same over arrays of nucleotide symbols, compared by code."""
    missing = lambda x: x.isin("?", "-", " ")
    return _count(u, v, lambda x, y: F.when(missing(y) & ~missing(x), True).when(missing(x) & ~missing(y), False).otherwise(x > y))


def _narrow(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, type]:
    """Both with loci as rows, in the smallest integers that hold their alleles, and the smallest that hold a distance: a kernel's time is that of its memory."""
    low, high = (min(u.min(initial=0), v.min(initial=0)), max(u.max(initial=0), v.max(initial=0)))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.ascontiguousarray(u.T.astype(kind)), np.ascontiguousarray(v.T.astype(kind)), next(t for t in (np.uint8, np.uint16, np.int64) if u.shape[1] <= np.iinfo(t).max)


#: Bits that an allele may take in planes of blocks; beyond, kernels compare the alleles themselves.
DEPTH = 8
#: Pairs whose bits a kernel holds at a time: they stay in a core's cache.
CACHED = 32_768


def coded(*rows: np.ndarray) -> list[np.ndarray] | None:
    """Matrices of alleles as bit planes (plane, word, row), highest first, a bit a locus; the missing ones, -1 and 0, come lowest. None where an allele would take over DEPTH bits."""
    low, high = min(x.min(initial=0) for x in rows), max(x.max(initial=0) for x in rows)
    depth = max(1, (int(high) - int(low) + (0 if low >= -1 else 2)).bit_length())
    if depth > DEPTH:
        return None
    out = []
    for x in rows:
        codes = (x - low if low >= -1 else np.where((x == -1) | (x == 0), x + 1, x - low + 2)).astype(np.uint8)
        codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 64)))
        out.append(np.stack([np.packbits(codes >> bit & 1, axis=1).view(np.uint64).T for bit in reversed(range(depth))]))
    return out


def _counted(x: np.ndarray, y: np.ndarray, costs: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Distances of every row of x to every row of y, both in planes, in the smallest integers that hold one. costs(a, b, out, spare) puts the bits that cost into out; a: (plane, row, 1), b: (plane, 1, row)."""
    n, m = x.shape[2], y.shape[2]
    dist = np.empty((n, m), np.uint8 if 64 * x.shape[1] <= 255 else np.uint16 if 64 * x.shape[1] < 1 << 16 else np.int64)
    step = max(1, CACHED // max(1, m))
    out, spare = np.empty((step, m), np.uint64), np.empty((step, m), np.uint64)  # used again: fresh memory costs more than the work
    for at in range(0, n, step):
        rows = min(step, n - at)
        for word in range(x.shape[1]):
            costs(x[:, word, at : at + step, None], y[:, word, None, :], out[:rows], spare[:rows])
            if word:
                dist[at : at + step] += np.bitwise_count(out[:rows])
            else:
                np.bitwise_count(out[:rows], out=dist[at : at + step])
    return dist


def hamming_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows in planes (coded())."""

    def costs(a, b, out, spare):
        np.bitwise_xor(a[0], b[0], out=out)
        for one, two in zip(a[1:], b[1:], strict=True):
            out |= np.bitwise_xor(one, two, out=spare)

    return _counted(x, y, costs)


def directional_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same from x to y: a locus costs where x is greater, and a higher plane decides where it differs."""

    def costs(a, b, out, spare):
        np.bitwise_and(a[-1], ~b[-1], out=out)
        for one, two in zip(a[-2::-1], b[-2::-1], strict=True):
            other = ~two
            out &= np.bitwise_or(one, other, out=spare)
            out |= np.bitwise_and(one, other, out=spare)

    return _counted(x, y, costs)


def hamming_block(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of every row of u to every row of v."""
    if held := coded(u, v):
        return hamming_bits(*held).astype(np.int64)
    a, b, kind = _narrow(u, v)
    out = np.zeros((len(u), len(v)), kind)
    for x, y in zip(a, b, strict=True):
        out += (x[:, None] != y[None, :]).view(np.uint8)
    return out.astype(np.int64)


def directional_block(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    if held := coded(u, v):
        return directional_bits(*held).astype(np.int64)
    a, b, kind = _narrow(u, v)
    out = np.zeros((len(u), len(v)), kind)
    if min(u.min(initial=0), v.min(initial=0)) >= -1:  # the missing ones, -1 and 0, lie below all others: whoever is lost or greater costs by order alone
        for x, y in zip(a, b, strict=True):
            out += (x[:, None] > y[None, :]).view(np.uint8)
        return out.astype(np.int64)
    for x, y in zip(a, b, strict=True):
        lost_x, lost_y = (x == -1) | (x == 0), (y == -1) | (y == 0)
        costs = x[:, None] > y[None, :]
        if lost_x.any() or lost_y.any():
            one = lost_x[:, None] != lost_y[None, :]
            costs = np.where(one, lost_y[None, :], costs)
        out += costs.view(np.uint8)
    return out.astype(np.int64)


def hamming_planes(u: list[Column], v: list[Column]) -> Column:
    """Bits of the loci at which two profiles differ. u, v: their alleles as bit planes, highest first; a bit a locus."""
    return reduce(Column.bitwiseOR, [x.bitwiseXOR(y) for x, y in zip(u, v, strict=True)])


def directional_planes(u: list[Column], v: list[Column]) -> Column:
    """Bits of the loci at which u is greater; the missing ones come lowest in planes, so these cost."""
    greater = None
    for x, y in reversed(list(zip(u, v, strict=True))):  # a higher plane decides where it differs
        more = x.bitwiseAND(F.bitwise_not(y))
        greater = more if greater is None else more.bitwiseOR(greater.bitwiseAND(F.bitwise_not(x.bitwiseXOR(y))))
    return greater


@dataclass(frozen=True)
class DistanceFunction:
    """A distance, as a column of two array columns and as a kernel over two blocks; symmetric ones need be computed one way only. planes: the loci that cost, as bits, of two profiles in bit planes.
    bits: the kernel over two blocks in bit planes."""

    description: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    symmetric: bool
    planes: Callable[[list[Column], list[Column]], Column] | None = None
    bits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


HAMMING = DistanceFunction("Hamming distance", hamming, hamming_block, True, hamming_planes, hamming_bits)
DIRECTIONAL = DistanceFunction("Directional Hamming distance", directional_hamming, directional_block, False, directional_planes, directional_bits)
