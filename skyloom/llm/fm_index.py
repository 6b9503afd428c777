"""An FM-index over a sequence of small integers, in NumPy: many patterns are searched together.

The text is a concatenation of runs; symbol 0 stands after each run and never matches. Suffixes are sorted by doubling, with every
separator a symbol of its own, so that the number of rounds is the logarithm of the longest run and not of the longest repeat.
Ranks come from a wavelet matrix, one bit vector of counts a level; positions come from every SAMPLE-th place of the text
and from the begin of each run.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    n = len(symbols)
    ends = symbols == 0
    k = int(ends.sum())
    rank = symbols.astype(np.int64) + k
    rank[ends] = np.arange(k)
    order, rank = _ordered(rank)
    step = 1
    while int(rank.max(initial=0)) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        order, rank = _ordered(rank * (n + 1) + after)
        step *= 2
    return order


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if len(key) else []
    return order, rank


class FmIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        """symbols: 0 separates, else below sigma; the last one is 0."""
        order = suffix_array(symbols)
        self.n = n = len(symbols)
        last = symbols[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int(n - ones.sum())))
            last = np.concatenate([last[ones == 0], last[ones == 1]])
        kept = (order % SAMPLE == 0) | (symbols[order - 1] == 0)  # no step back crosses a separator
        self.sampled = kept
        self.sample_at = np.cumsum(kept) - 1
        self.samples = order[kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before i in the last column."""
        lo = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - lo

    def symbol(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last column's symbol in each row and its rank there."""
        got, lo, i = np.zeros_like(row), np.zeros_like(row), row
        for bit, ones, zeros in self.levels:
            one = (ones[i + 1] - ones[i]).astype(bool)
            got |= one.astype(np.int64) << bit
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return got, i - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the rows of ``patterns``: those that occur, and their ranges of suffixes."""
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j].astype(np.int64)
            lo, hi = self.below[c] + self.rank(c, lo), self.below[c] + self.rank(c, hi)
            found = hi > lo
            alive, lo, hi = alive[found], lo[found], hi[found]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        at, steps = np.full(len(rows), -1, np.int64), 0
        open_, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            known = self.sampled[row]
            at[open_[known]] = self.samples[self.sample_at[row[known]]] + steps
            open_, row = open_[~known], row[~known]
            if len(open_):
                c, r = self.symbol(row)
                row = self.below[c] + r
            steps += 1
        return at
