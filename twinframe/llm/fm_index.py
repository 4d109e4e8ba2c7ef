"""A word-level FM-index over one training shard, in numpy.

The shard is one integer sequence (1.. are words, 0 separates runs). Its suffixes are sorted by prefix doubling, the Burrows-Wheeler
transform goes into a wavelet matrix that answers rank queries for many symbols at once, and every ``sample``-th text position is
kept for locating occurrences by walking back.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes; separators differ from each other (earlier is smaller), so ties end at the next one."""
    n = len(text)
    rank = np.where(text == 0, np.cumsum(text == 0) - 1, text.astype(np.int64) + n)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    span = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - span)] = rank[span:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1]))) if n else order
        rank[order] = fresh
        if not n or fresh[-1] == n - 1:
            return order
        span *= 2


class FMIndex:
    """Backward search and locating over ``text``, an array of integers from 0 that ends with 0."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]  # the suffix at 0 is preceded by the final separator
        self.n = n
        symbols = int(text.max()) + 1 if n else 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ranks, self.zeros = [], []
        row = bwt.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ranks.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        kept = (order % sample == 0) | (bwt == 0)  # and each run's first position: a walk never crosses a separator
        self.marked = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.samples = order[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``at`` symbols of the transform."""
        lo, hi = np.zeros_like(at), at
        for level, ranks, zeros in zip(reversed(range(self.levels)), self.ranks, self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            lo = np.where(one, zeros + ranks[lo], lo - ranks[lo])
            hi = np.where(one, zeros + ranks[hi], hi - ranks[hi])
        return hi - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The transform's symbol at each row."""
        out = np.zeros_like(at)
        for level, ranks, zeros in zip(reversed(range(self.levels)), self.ranks, self.zeros):
            one = ranks[at + 1] - ranks[at]
            out |= one.astype(out.dtype) << level
            at = np.where(one == 1, zeros + ranks[at], at - ranks[at])
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval [lo, hi) of each phrase. ``phrases``: a row each, filled up at the right; symbols over the text's don't match."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        last = len(self.first) - 2
        for back in range(1, int(lengths.max()) + 1 if len(lengths) else 1):
            on = np.flatnonzero((lengths >= back) & (hi > lo))
            if not len(on):
                break
            sym = phrases[on, lengths[on] - back].astype(np.int64)
            known = sym <= last
            safe = np.where(known, sym, 0)
            a = self.first[safe] + self.rank(safe, lo[on])
            b = self.first[safe] + self.rank(safe, hi[on])
            lo[on], hi[on] = np.where(known, a, 0), np.where(known, b, 0)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: walk back to the nearest sampled one."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            row = at[left]
            found = self.marked[row + 1] > self.marked[row]
            hit = left[found]
            out[hit] = self.samples[self.marked[at[hit]]] + steps[hit]
            left = left[~found]
            if len(left):
                sym = self.symbol(at[left])
                at[left] = self.first[sym] + self.rank(sym, at[left])
                steps[left] += 1
        return out
