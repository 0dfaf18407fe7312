"""An FM-index over integer symbols: suffix order, wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes. Symbol 0 separates: each 0 is smaller than all else and than later 0s."""
    zero = seq == 0
    n_zero = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, seq.astype(np.int64) + n_zero - 1)
    step, n = 1, len(seq)
    while True:
        _, rank = np.unique(rank, return_inverse=True)
        if step >= n or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")
        key = rank.astype(np.int64) * (n + 1)
        key[: n - step] += rank[step:] + 1
        rank, step = key, step * 2


class WaveletTree:
    """How often a symbol occurs before a place, in as many steps as symbols have bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(place), place.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before it."""
        symbol, start, at = np.zeros_like(place), np.zeros_like(place), place.copy()
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] > ones[at]
            symbol = symbol * 2 + one
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return symbol, at - start


class FMIndex:
    """Over a sequence of symbols 0..top that ends with 0; 0 separates and is never searched for."""

    def __init__(self, seq: np.ndarray, top: int, sample: int = 8):
        order = suffix_order(seq)
        bwt = seq[order - 1]
        self.tree = WaveletTree(bwt, max(1, int(top).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))]).astype(np.int64)
        # a walk to the left ends at a sampled position; starts of runs are sampled too, so no walk crosses a separator
        kept = (order % sample == 0) | (bwt == 0)
        self.kept, self.kept_rank, self.kept_at = kept, np.concatenate([[0], np.cumsum(kept)]), order[kept]
        self.n = len(seq)

    def search(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of the suffixes that start with each pattern, the lengths[i] symbols from starts[i]."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        on = np.arange(len(starts))
        for step in range(1, int(lengths.max(initial=0)) + 1):
            on = on[(step <= lengths[on]) & (low[on] < high[on])]
            c = symbols[starts[on] + lengths[on] - step].astype(np.int64)
            low[on] = self.below[c] + self.tree.rank(c, low[on])
            high[on] = self.below[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of these rows of the suffix order."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            there = self.kept[rows[left]]
            done = left[there]
            out[done] = self.kept_at[self.kept_rank[rows[done]]] + steps[done]
            left = left[~there]
            c, r = self.tree.symbol_and_rank(rows[left])
            rows[left] = self.below[c] + r
            steps[left] += 1
        return out
