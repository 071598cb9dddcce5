"""FM-index over sequences of integers, for many backward searches at a time."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A packed bit vector with the count of ones before every 64-bit word."""

    __slots__ = ("words", "before")

    def __init__(self, bits: np.ndarray) -> None:
        size = (len(bits) // 64 + 1) * 64
        full = np.zeros(size, dtype=np.uint8)
        full[: len(bits)] = bits
        self.words = np.packbits(full, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector per bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels: list[tuple[_Bits, int]] = []
        row = symbols
        for bit in range(self.bits - 1, -1, -1):
            own = (row >> bit) & 1
            zeros = int(len(own) - own.sum())
            self.levels.append((_Bits(own.astype(np.uint8)), zeros))
            row = np.concatenate((row[own == 0], row[own == 1]))
        self.first = self._down(np.arange(alphabet), np.zeros(alphabet, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first `at` entries."""
        return self._down(symbol, at) - self.first[symbol]


class FmIndex:
    """Backward search for patterns of up to `longest` symbols.

    `symbols` are integers from 0 on. Suffixes are put in order by their first `longest` symbols
    only, which is all that such patterns can tell apart.
    """

    def __init__(self, symbols: np.ndarray, longest: int) -> None:
        self.longest = longest
        self.known = int(symbols.max(initial=0)) + 1
        symbols = np.append(symbols, self.known)  # an end that no pattern contains
        alphabet = self.known + 1
        rank, step = symbols.astype(np.int64), 1
        while step < longest:
            after = np.zeros_like(rank)
            after[: max(0, len(rank) - step)] = rank[step:] + 1
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1]
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.matrix = WaveletMatrix(symbols[self.order - 1], alphabet)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet))))

    def intervals(self, patterns: np.ndarray, occur: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Range of the suffix order that begins with each row of `patterns`; empty if none does.

        With `occur` all patterns are known to occur, so a range of one suffix stays one.
        """
        last = patterns[:, -1]
        low, high = self.below[last].copy(), self.below[last + 1].copy()
        active = np.flatnonzero(low < high)
        for column in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[active, column]
            new_low = self.below[symbol] + self.matrix.rank(symbol, low[active])
            new_high = new_low + 1
            wide = np.flatnonzero(high[active] - low[active] > 1) if occur else np.arange(len(active))
            new_high[wide] = self.below[symbol[wide]] + self.matrix.rank(symbol[wide], high[active[wide]])
            low[active], high[active] = new_low, new_high
            active = active[new_low < new_high]
        return low, high

    def matching_statistics(self, stream: np.ndarray) -> np.ndarray:
        """Length of the longest match, `longest` at most, that begins at each place of `stream`.

        Symbols outside the alphabet match nothing.
        """
        out = np.zeros(len(stream), dtype=np.int64)
        known = (stream >= 0) & (stream < self.known)
        active = np.flatnonzero(known)
        for length in range(1, self.longest + 1):
            active = active[active + length <= len(stream)]
            active = active[known[active + length - 1]]
            low, high = self.intervals(stream[active[:, None] + np.arange(length)])
            active = active[low < high]
            out[active] = length
        return out
