"""Searches in sorted arrays, many at a time: bounds of a band, the first points of a box, order statistics of a range."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Points of a leaf of a tree, and searches that go down it together.
_LEAF, _TOGETHER = 16, 4096


def first_not(low: np.ndarray, high: np.ndarray, before: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The first place of each [low, high) where before(places) doesn't hold, else high; once it doesn't hold, it holds no more."""
    low, high = low.copy(), high.copy()
    while (left := low < high).any():
        mid = np.where(left, (low + high) // 2, 0)
        on = before(mid)
        low, high = np.where(left & on, mid + 1, low), np.where(left & ~on, mid, high)
    return low


def starts(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes starts in rows sorted by code, and their number."""
    return np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))])


def places_in_ranges(values: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The value at a place, from 0, of the sorted values of each range [low, high) of rows; a row counts as often as its weight.

    Places below 0 are the first; those behind a range give NaN. Values are told apart a bit of their rank at a time: rows with
    a zero move to the front, each range becomes one of those or of the others, and only one such step is held at a time.
    """
    upto = np.concatenate([[0], np.cumsum(weights)])
    there, left, found = (low < high) & (places < upto[high] - upto[low]), np.maximum(places, 0), np.zeros(len(low), int)
    known, codes = np.unique(values, return_inverse=True)
    for bit in reversed(range((len(known) - 1).bit_length() if len(known) else 0)):
        zero = (codes >> bit) & 1 == 0
        front, below = np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0], np.cumsum(np.where(zero, weights, 0))])
        less = below[high] - below[low]
        on = left >= less
        left, found = left - np.where(on, less, 0), found | (on.astype(int) << bit)
        low, high = (np.where(on, front[-1] + x - front[x], front[x]) for x in (low, high))
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        codes, weights = codes[order], weights[order]
    return np.where(there, known[np.where(there, found, 0)], np.nan) if len(known) else np.full(len(low), np.nan)


class BoxTree:
    """Points by their ranks in each dimension, no two alike; their order is that of the rows."""

    def __init__(self, ranks: Sequence[np.ndarray], k: int):
        """For the k first points of boxes."""
        self.n, self.k, self.leaf = len(ranks[0]), k, max(_LEAF, 1 << (k - 1).bit_length())
        self.depth = max(0, -(-self.n // self.leaf) - 1).bit_length()
        size = self.leaf << self.depth
        self.ranks = [np.concatenate([r, np.arange(self.n, size)]) for r in ranks]  # what fills the leaves lies behind all points
        order = np.arange(size)
        for level in range(self.depth):
            at = order.reshape(1 << level, -1)
            half = np.argpartition(self.ranks[level % len(ranks)][at], at.shape[1] // 2, axis=1)
            order = np.take_along_axis(at, half, axis=1).ravel()
        self.leaves = order.reshape(-1, self.leaf)
        spans = [(r[self.leaves].min(axis=1), r[self.leaves].max(axis=1)) for r in self.ranks]
        tops = np.sort(np.minimum(self.leaves, self.n), axis=1)[:, :k]
        self.levels = [(spans, tops)]
        for _ in range(self.depth):
            spans = [(a.reshape(-1, 2).min(axis=1), b.reshape(-1, 2).max(axis=1)) for a, b in spans]
            tops = np.sort(tops.reshape(len(tops) // 2, -1), axis=1)[:, :k]
            self.levels.insert(0, (spans, tops))

    def first(self, low: Sequence[np.ndarray], high: Sequence[np.ndarray]) -> np.ndarray:
        """The k first points of each box of ranks [low, high), as rows; n stands for none."""
        cuts = range(0, len(low[0]), _TOGETHER)
        found = [self._first([a[i : i + _TOGETHER] for a in low], [b[i : i + _TOGETHER] for b in high]) for i in cuts]
        return np.concatenate(found) if found else np.empty((0, self.k), int)

    def _first(self, low: Sequence[np.ndarray], high: Sequence[np.ndarray]) -> np.ndarray:
        best = np.full((len(low[0]), self.k), self.n)
        q = np.flatnonzero(np.all([a < b for a, b in zip(low, high, strict=True)], axis=0))
        node = np.zeros(len(q), int)
        for level, (spans, tops) in enumerate(self.levels):
            keep = tops[node, 0] < best[q, -1]  # a node without a point before those found has nothing to add
            for (a, b), x, y in zip(spans, low, high, strict=True):
                keep &= (a[node] < y[q]) & (b[node] >= x[q])
            q, node = q[keep], node[keep]
            inside = np.ones(len(q), bool)
            for (a, b), x, y in zip(spans, low, high, strict=True):
                inside &= (a[node] >= x[q]) & (b[node] < y[q])
            self._add(best, q[inside], tops[node[inside]])
            q, node = q[~inside], node[~inside]
            if level < self.depth:
                q, node = np.repeat(q, 2), np.repeat(node * 2, 2)
                node[1::2] += 1
        rows = self.leaves[node]
        hit = rows < self.n
        for r, x, y in zip(self.ranks, low, high, strict=True):
            hit &= (r[rows] >= x[q][:, None]) & (r[rows] < y[q][:, None])
        self._add(best, q, np.sort(np.where(hit, rows, self.n), axis=1)[:, : self.k])
        return best

    def _add(self, best: np.ndarray, q: np.ndarray, rows: np.ndarray) -> None:
        who = np.unique(q)
        by, rows = np.concatenate([np.repeat(q, self.k), np.repeat(who, self.k)]), np.concatenate([rows.ravel(), best[who].ravel()])
        by, rows = by[rows < self.n], rows[rows < self.n]
        order = np.lexsort((rows, by))
        by, rows = by[order], rows[order]
        place = np.arange(len(by)) - np.searchsorted(by, by)
        best[by[place < self.k], place[place < self.k]] = rows[place < self.k]
