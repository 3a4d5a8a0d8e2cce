"""Products of two blocks of vectors in single precision, a tile at a time, and what can be told from them.

A tile stays in a core's cache. Rough products lie within a known slack of the exact ones: they settle most pairs, and only the pairs
that they leave open are scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np

#: Products of a tile, and its columns at most; no more than 2,040, see counted().
PRODUCTS, COLUMNS = 1 << 19, 1024
#: Pairs that are scored exactly at a time.
PAIRS = 1024

Tile = tuple[slice, slice, np.ndarray]


def slack(size: int, kind: type = np.float32) -> float:
    """By how much products of so many entries may be off, relative to the product of norms: twice the bound for sums in any order."""
    return (size + 8) * float(np.finfo(kind).eps)


def products(a: np.ndarray, b: np.ndarray, kind: type = np.float32, most: int = PRODUCTS) -> Iterator[Tile]:
    """(rows, columns, products) of a's rows with b's, at most so many at a time, row by row of tiles; the next tile takes the place of one."""
    width = min(COLUMNS, most)
    height = most // width
    held = np.empty((height, width), kind)
    with np.errstate(all="ignore"):
        a, b = a.astype(kind), np.ascontiguousarray(b.T, dtype=kind)
        for r in range(0, len(a), height):
            for c in range(0, b.shape[1], width):
                rows, columns = slice(r, min(r + height, len(a))), slice(c, min(c + width, b.shape[1]))
                shape = rows.stop - r, columns.stop - c
                yield rows, columns, np.matmul(a[rows], b[:, columns], out=held if shape == held.shape else None)


def strict_sums(rows: int, entries: Iterator[np.ndarray]) -> np.ndarray:
    """Sums of entries from the first on, as vec.total and SQL add them up: rows of equal bits have equal sums."""
    out = np.zeros(rows)
    for x in entries:
        out += x
    return out


def paired(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, entry: Callable) -> np.ndarray:
    """Strict sums of entry(x, y) over the positions of rows i of a and j of b."""
    out = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for c in range(0, len(i), PAIRS):
            found = entry(a[i[c : c + PAIRS]], b[j[c : c + PAIRS]])
            out[c : c + PAIRS] = strict_sums(len(found), np.ascontiguousarray(found.T))
    return out


def counted(mask: np.ndarray) -> np.ndarray:
    """How many entries of each row are true; eight bytes are added up at a time."""
    if mask.shape[1] % 8:
        return mask.sum(axis=1)
    return mask.view(np.uint64).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true entries, which are few."""
    if mask.shape[1] % 8:
        return np.nonzero(mask)
    at = (np.flatnonzero(mask.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[mask.ravel()[at]], mask.shape[1])


def _likeliest(i: np.ndarray, j: np.ndarray, rough: np.ndarray, k: int, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs those that may be among the k best of their row, and each row's least product for that."""
    order = np.lexsort((-rough, i))
    i, j, rough = i[order], j[order], rough[order]
    last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
    least = np.full(len(off), -np.inf, rough.dtype)
    least[i[last]] = rough[last] - 2 * off[i[last]]
    kept = rough >= least[i]
    return i[kept], j[kept], rough[kept], least


def best(tiles: Iterator[Tile], k: int, off: np.ndarray, place: np.ndarray, exact: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best columns of each row by exact(rows, columns), NaN first and equal ones by place.

    A tile's entries lie within off of the exact scores of their row, are -inf where there is no pair and inf where the score is NaN.
    """
    found = []
    for first, group in groupby(tiles, key=lambda tile: tile[0].start):
        pairs, least, n = (), None, 0
        for n, (rows, columns, rough) in enumerate(group, 1):
            if least is None:
                kth, mine = max(0, rough.shape[1] - k), off[rows].astype(rough.dtype)
                least = np.partition(rough, kth, axis=1)[:, kth] - 2 * mine if rough.shape[1] >= k else np.full(len(rough), -np.inf, rough.dtype)
            likely = rough >= least[:, None]
            i, j = places(likely & (rough > -np.inf) if np.isneginf(least).any() else likely)
            new = (i, j + columns.start, rough[i, j])
            pairs = tuple(np.concatenate(x) for x in zip(pairs, new, strict=True)) if pairs else new
            if not n & (n - 1):
                *pairs, least = _likeliest(*pairs, k, mine)
        i, j, _, _ = _likeliest(*pairs, k, mine)
        i = i + first
        score = exact(i, j)
        order = np.lexsort((place[j], np.where(np.isnan(score), -np.inf, -score), i))
        i, j, score = i[order], j[order], score[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[kept], j[kept], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
