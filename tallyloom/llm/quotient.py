"""Counting quotient filters in their packed form, built from sorted fingerprints and merged losslessly."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BIIB")


def encode(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of sorted distinct fingerprints (uint64, of so many bits) and their counts.

    A fingerprint is its quotient (high bits; as many as give about one fingerprint a quotient) and
    its remainder. Remainders stand in the order of the fingerprints; a bit for each quotient says
    whether it is occupied, and a bit for each remainder whether it ends its quotient's run. Counts
    above one stand apart, behind a bit for each remainder.
    """
    n = len(fingerprints)
    q = max(0, min(bits - 1, int(n).bit_length() - 1, 30))
    width = -(-(bits - q) // 8)
    quotient = (fingerprints >> np.uint64(bits - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    remainder = fingerprints & np.uint64((1 << (bits - q)) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)
    above = counts > 1
    parts = [
        _HEAD.pack(q, n, int(above.sum()), bits),
        np.packbits(occupied).tobytes(),
        np.packbits(ends).tobytes(),
        np.packbits(above).tobytes(),
        np.ascontiguousarray(remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]).tobytes(),
        counts[above].astype("<u8").tobytes(),
    ]
    return b"".join(parts)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts of a filter."""
    q, n, m, bits = _HEAD.unpack_from(data)
    at, width = _HEAD.size, -(-(bits - q) // 8)

    def flags(count: int) -> np.ndarray:
        nonlocal at
        size = -(-count // 8)
        out = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count).astype(bool)
        at += size
        return out

    occupied, ends, above = flags(1 << q), flags(n), flags(n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    fingerprints = wide.view("<u8").ravel() | (quotient << np.uint64(bits - q) if q else np.uint64(0))
    counts = np.ones(n, np.uint64)
    counts[above] = np.frombuffer(data, "<u8", m, at)
    return fingerprints, counts


def _two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted sequence of distinct fingerprints with counts from two, in one pass over each."""
    (x, cx), (y, cy) = a, b
    if not len(x) or not len(y):
        return a if len(x) else b
    at = np.searchsorted(x, y)
    same = x[np.minimum(at, len(x) - 1)] == y
    added = cx.copy()
    added[at[same]] += cy[same]
    place = at[~same] + np.arange(int((~same).sum()))
    old = np.ones(len(x) + len(place), bool)
    old[place] = False
    values, counts = np.empty(len(old), x.dtype), np.empty(len(old), cx.dtype)
    values[place], counts[place], values[old], counts[old] = y[~same], cy[~same], x, added
    return values, counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of all filters with their added counts; nothing is lost.

    Filters hold fingerprints in the order of quotient and remainder, so they are merged two by two in that
    order, in a tree: log2 of their number passes, and no sort."""
    parts = [decode(x) for x in filters]
    while len(parts) > 1:
        parts = [_two(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
