"""Weighted minwise signatures by darts: every element's weight region is thrown hashed darts, and each
coordinate keeps the earliest dart that hits.

Elements are word shingles, weights how often they occur; any weight from 0 on will do. An element's region
reaches from 0 to its weight and is cut at 1, 2, 4, 8 and so on. Darts arrive in each cut as a Poisson process
whose rate is the cut's width, made of hashes of the element and the cut alone, so texts that share an
element share its darts; a dart beyond the text's own weight misses. A text of weight W looks at darts up to
time t / W: at most 2 t darts in all, whatever its length and its counts, and more time only for coordinates
that none has hit.
"""

from __future__ import annotations

import sys
from functools import cache
from itertools import pairwise

import numpy as np
import xxhash

#: Shingles of SHINGLE words; BANDS bands of ROWS coordinates.
SHINGLE, ROWS, BANDS = 5, 5, 26
COORDINATES = ROWS * BANDS
#: Darts that a text looks at first: so many for each coordinate that most texts need no more.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 3))
#: Characters whose hashes are held at once, unless one text has more.
CHARACTERS = 1 << 18


@cache
def _in_words() -> np.ndarray:
    r"""For each code point, whether it is a letter, a digit or an underscore, as in \w."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64 bits (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and how many each text has; about CHARACTERS are taken at once."""
    turn = np.cumsum([len(x) for x in texts]) // CHARACTERS
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(texts)]
    return tuple(np.concatenate(x) for x in zip(*(_hash_some(texts[a:b]) for a, b in pairwise(cuts)), strict=True))


def _hash_some(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is the mixed sum of hashes of its characters, each with its place in the word."""
    lowered = [x.lower() for x in texts]
    points = np.frombuffer("\0".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _in_words()[points]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    begin = np.cumsum(length) - length
    place = (np.arange(int(length.sum())) - np.repeat(begin, length)).astype(np.uint64)
    hashed = mix(points[inside] | place << np.uint64(21))
    ends = np.cumsum([len(x) + 1 for x in lowered])
    return mix(np.add.reduceat(hashed, begin)) if len(begin) else np.zeros(0, np.uint64), np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(texts))


def _order(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Order by row, then value; row is small and is sorted by radix."""
    by_value = np.argsort(values)
    return by_value[np.argsort(row[by_value].astype(np.uint16), kind="stable")] if len(row) and row[-1] < 1 << 16 else np.lexsort((values, row))


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct elements of all texts (uint64, sorted in each text), their weights, and how many each
    text has.

    Words are runs of letters, digits and underscores in lower case. A text of fewer words than SHINGLE
    is one shingle; a text without words is one element, the hash of the whole text."""
    hashed, counts = _hash_words(texts)
    wide = np.append(hashed, np.zeros(SHINGLE, np.uint64))
    row = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashed))  # words up to the text's end
    total = np.zeros(len(hashed), np.uint64)
    for n in range(SHINGLE):
        total = np.where(left > n, mix(total * np.uint64(31) + wide[n : n + len(hashed)]), total)
    first = np.zeros(len(hashed), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    whole = (left >= SHINGLE) | first & (counts[row] < SHINGLE)
    bare = np.flatnonzero(counts == 0)
    if len(bare):
        row = np.append(row[whole], bare)
        total = np.append(total[whole], mix(np.array([xxhash.xxh64_intdigest(texts[i].encode("utf-8", "surrogatepass"), seed=1) for i in bare.tolist()], np.uint64)))
        by_row = np.argsort(row, kind="stable")
        row, total = row[by_row], total[by_row]
    else:
        row, total = row[whole], total[whole]
    order = _order(total, row)
    row, total = row[order], total[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (total[1:] != total[:-1]))) if len(row) else np.zeros(0, np.int64)
    return total[new], np.diff(np.append(new, len(row))).astype(float), np.bincount(row[new], minlength=len(texts))


def _regions(element: np.ndarray, weight: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """The cuts of all elements: hash, text, low end, width and the element's weight."""
    cuts = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    of = np.repeat(np.arange(len(element)), cuts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    low = np.where(nth > 0, 2.0 ** (nth - 1), 0.0)
    return np.where(nth > 0, mix(element[of] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), element[of]), text[of], low, np.maximum(low, 1.0), weight[of]


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(element: np.ndarray, weight: np.ndarray, text: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts that hit before until[text]: text * COORDINATES + coordinate, time and the dart's hash.

    Most elements weigh 1 and have one cut, from 0 to 1, which every dart hits."""
    one = weight == 1
    found = _arrive(element[one], text[one], until)
    if not one.all():
        region, own, low, width, most = _regions(element[~one], weight[~one], text[~one])
        found += _arrive(region, own, until, low, width, most)
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))


def _arrive(region: np.ndarray, text: np.ndarray, until: np.ndarray, low=None, width=None, weight=None) -> list[tuple]:
    """Darts of cuts of the given low ends and widths (0 and 1 if None) that fall below the weights."""
    found, time, serial = [], np.zeros(len(region)), 0
    while len(region):
        steps = max(1, min(32, 60_000 // len(region)))
        n = (serial + np.arange(steps, dtype=np.uint64))[None, :]
        dart = mix(region[:, None] ^ mix(n + np.uint64(1)))
        wait = -np.log(_unit(mix(dart)))
        if width is not None:
            wait /= width[:, None]
        times = time[:, None] + np.cumsum(wait, axis=1)
        i, j = np.nonzero(times < until[text][:, None])
        hit = dart[i, j]
        if width is not None:
            inside = low[i] + width[i] * _unit(mix(hit ^ np.uint64(0x94D049BB133111EB))) < weight[i]
            i, j, hit = i[inside], j[inside], hit[inside]
        found.append((text[i] * COORDINATES + (hit % np.uint64(COORDINATES)).astype(np.int64), times[i, j], hit))
        alive = times[:, -1] < until[text]
        region, text, time, serial = region[alive], text[alive], times[alive, -1], serial + steps
        if width is not None:
            low, width, weight = low[alive], width[alive], weight[alive]
    return found


def signatures(element: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) hashes of earliest darts; rows of texts without elements are 0."""
    out = np.zeros((len(counts), COORDINATES), np.uint64)
    starts = np.cumsum(counts) - counts
    todo, factor = np.flatnonzero(counts), 1.0
    total = np.zeros(len(counts))
    if len(todo):
        total[todo] = np.add.reduceat(weight, starts[todo])
    while len(todo):
        own = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in todo])
        key, time, dart = _throw(element[own], weight[own], np.repeat(np.arange(len(todo)), counts[todo]), factor * DARTS / total[todo])
        # times of one key are told apart by 32 bits, as good as any
        packed = key.astype(np.uint64) << np.uint64(32) | time.astype(np.float32).view(np.uint32)
        order = np.argsort(packed)
        key = key[order]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        part = np.zeros(len(todo) * COORDINATES, np.uint64)
        part[key[first]] = dart[order][first]
        filled = np.bincount(key[first].astype(np.int64) // COORDINATES, minlength=len(todo)) == COORDINATES
        out[todo] = part.reshape(-1, COORDINATES)
        todo, factor = todo[~filled], factor * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the coordinates of each band."""
    parts = signature.reshape(-1, BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key ^ parts[:, :, r])
    return key


def pack(element: np.ndarray, weight: np.ndarray) -> bytes:
    """One text's sorted elements and weights."""
    return element.tobytes() + weight.astype(np.float64).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 16
    return np.frombuffer(data, np.uint64, half), np.frombuffer(data, np.float64, half, 8 * half)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts: the sum of lesser weights by the sum of greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    return shared / max(float(a[1].sum() + b[1].sum()) - shared, 1e-300)
