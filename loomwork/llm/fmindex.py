"""A compressed FM-index of integer sequences, searched backward for many patterns at once.

The Burrows-Wheeler transform is held in a wavelet matrix: one packed bit vector for each
bit of the alphabet, with a running count for every 64 bits. All methods take and give
numpy arrays, so that a step of thousands of searches costs a few array operations.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling; quick where long repeats are short, as they are between unique separators."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, h = np.argsort(rank, kind="stable"), 1
    while True:
        later = np.zeros(n, np.int64)
        later[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key)
        k = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank, h = new, 2 * h
        if h >= n or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    def __init__(self, values: np.ndarray, alphabet: int):
        self.levels = list(range(max(1, int(alphabet - 1).bit_length())))[::-1]
        self.words, self.counts, self.zeros = [], [], []
        now = values
        for level in self.levels:
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1])
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.base = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in zip(self.levels, self.words, self.counts, self.zeros, strict=True):
            i = at >> 6
            ones = counts[i] + np.bitwise_count(words[i] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before the place."""
        return self._down(symbol, at) - self.base[symbol]


class FmIndex:
    """Of a sequence of symbols 0 .. alphabet - 1."""

    def __init__(self, text: np.ndarray, alphabet: int):
        order = suffix_array(text)
        self.n = len(text)
        self.matrix = WaveletMatrix(text[order - 1], alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])[:-1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of each pattern with the symbol in front."""
        both = self.before[np.tile(symbol, 2)] + self.matrix.rank(np.tile(symbol, 2), np.concatenate([low, high]))
        return both[: len(symbol)], both[len(symbol) :]

    def repeated(self, text: np.ndarray, begin: np.ndarray, windows: np.ndarray, width: int, least: int = 2) -> np.ndarray:
        """For sequences text[begin : begin + windows + width - 1]: a bit for each window that occurs `least` times or more.

        Matching statistics as far as they are needed: from a window's end, search backward as
        long as the match occurs often enough. If that reaches the window's begin, all windows
        within the match occur as often; the search goes on at the rightmost window not decided.
        """
        found = np.zeros(len(begin), np.int64)
        window = windows - 1  # the rightmost that isn't decided
        at = window + width
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.n)
        active = np.flatnonzero(windows > 0)
        while len(active):
            lo, hi = self.extend(text[begin[active] + at[active] - 1], low[active], high[active])
            ok = hi - lo >= least
            going = active[ok]
            at[going] -= 1
            low[going], high[going] = lo[ok], hi[ok]
            over = np.concatenate([active[~ok], going[at[going] == 0]])
            if len(over):
                s, w = at[over], window[over]
                run = np.maximum(w - s + 1, 0)  # windows s .. w
                found[over] |= ((np.int64(1) << run) - 1) << np.minimum(s, w)
                window[over] = np.where(run > 0, s, w) - 1
                at[over], low[over], high[over] = window[over] + width, 0, self.n
            active = active[window[active] >= 0]
        return found
