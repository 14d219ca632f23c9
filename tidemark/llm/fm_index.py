"""An FM-index over integer symbols, built and searched with array operations.

Symbol 0 ends a stretch; every end counts as a symbol of its own, so no match runs over it. The suffix array comes from
prefix doubling, the last column goes into a wavelet tree with one cumulative bit count a level, and every sample-th
text position is kept for locating. Many patterns are searched at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; symbols must end with 0."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    key = symbols.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))  # unlike each other, below all symbols
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)  # of the group that each suffix is in so far: where the group starts in order
    at, step = np.arange(n), 1
    while True:
        change = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[at]] = at[np.maximum.accumulate(np.where(change, np.arange(len(at)), 0))]
        # only suffixes that are not yet alone have to move
        tied = ~change
        tied[:-1] |= ~change[1:]
        at = at[tied]
        if not len(at):
            return order
        part = order[at]
        key = rank[part] * n + rank[part + step]  # a tied suffix is longer than step: ends are unlike each other
        by = np.argsort(key)
        order[at], key = part[by], key[by]
        step *= 2


class WaveletTree:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            flags = ((now >> level) & 1).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(flags, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(now) - ones[-1]))
            now = np.concatenate((now[~flags], now[flags]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first, at = np.zeros_like(at), at
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ones, zeros = self.ones[level], self.zeros[level]
            at = np.where(one, zeros + ones[at], at - ones[at])
            first = np.where(one, zeros + ones[first], first - ones[first])
        return at - first


class FMIndex:
    def __init__(self, symbols: np.ndarray, top: int, sample: int = 16):
        order = suffix_array(symbols)
        self.n, self.sample = len(symbols), sample
        self.last = symbols[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        self.tree = WaveletTree(self.last, max(1, int(top).bit_length()))
        self.marked = order % sample == 0
        self.mark_rank = np.cumsum(self.marked) - 1
        self.samples = order[self.marked]
        self.ends = np.flatnonzero(self.last == 0)
        self.first_of_end = order[self.ends]  # a stretch's own start: the walk may stop there

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns of one length, one pattern a row, by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled position or the start of a stretch."""
        out = np.empty(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            marked = self.marked[at]
            out[live[marked]] = self.samples[self.mark_rank[at[marked]]] + steps
            live, at = live[~marked], at[~marked]
            symbol = self.last[at]
            start = symbol == 0
            if start.any():
                out[live[start]] = self.first_of_end[np.searchsorted(self.ends, at[start])] + steps
                live, at, symbol = live[~start], at[~start], symbol[~start]
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
