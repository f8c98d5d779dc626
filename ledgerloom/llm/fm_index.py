"""FM-index over a sequence of symbols, searched for many patterns at once with numpy.

Symbol 0 separates: no pattern holds it, and each 0 counts as a symbol of its
own, smaller than all others. The suffix array is sorted by packed prefixes and
then by doubling the compared length for the suffixes that still tie. What is
kept is the index alone: a wavelet matrix over the Burrows-Wheeler transform, the
symbol counts and a sample of the suffix positions.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 32
_ONE = np.uint64(1)


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.words = np.pad(packed, (0, 8 + -len(packed) % 8)).view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.zeros(len(ones), np.int64)
        np.cumsum(ones[:-1], out=self.before[1:])
        self.ones = int(flags.sum())

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & _ONE).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class WaveletMatrix:
    """Ranks of symbols and the symbol at a place, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(bits - 1, -1, -1):
            high = (symbols >> shift & 1).astype(bool)
            level = Bits(high)
            self.levels.append((shift, level, len(symbols) - level.ones))
            symbols = np.concatenate([symbols[~high], symbols[high]])

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level, zeros in self.levels:
            ones = level.rank(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbols, at) - self._down(symbols, np.zeros_like(at))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros_like(at)
        for shift, level, zeros in self.levels:
            high, ones = level[at], level.rank(at)
            found |= high.astype(at.dtype) << shift
            at = np.where(high, zeros + ones, at - ones)
        return found


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Starts of all suffixes in order; equal separators order by place. ``symbols`` ends with a separator."""
    n, packed = len(symbols), max(1, 62 // bits)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(packed):
        here = np.zeros(n, np.int64)
        here[: max(0, n - j)] = symbols[j:]
        here[~open_] = 0
        open_ &= here != 0
        key = key << bits | here
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(n, bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | ~open_[order[1:]]
    del key, ordered
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = ~first
    tied[:-1] |= ~first[1:]
    active, length = np.flatnonzero(tied), packed
    while len(active):
        starts = order[active]
        key = rank[starts] * n + rank[starts + length]
        again = np.argsort(key, kind="stable")
        starts, key = starts[again], key[again]
        order[active] = starts
        first = np.ones(len(active), bool)
        first[1:] = key[1:] != key[:-1]
        rank[starts] = np.maximum.accumulate(np.where(first, active, 0))
        tied = ~first
        tied[:-1] |= ~first[1:]
        active, length = active[tied], length * 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        """``symbols`` are below ``alphabet``; the last one must be 0."""
        self.n, bits = len(symbols), max(1, (alphabet - 1).bit_length())
        order = suffix_order(symbols, bits)
        last = symbols[order - 1]
        last[order == 0] = 0
        self.before = np.zeros(alphabet + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=alphabet), out=self.before[1:])
        # A walk back through the text ends at a sampled place or behind a separator.
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]
        self.wavelet = WaveletMatrix(last, bits)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, and the range of suffixes that start with each.

        ``patterns`` has a row for each pattern, filled up at the end.
        """
        which = np.arange(len(patterns))
        last = patterns[which, lengths - 1]
        low, high = self.before[last], self.before[last + 1]
        found = []
        for step in range(2, int(lengths.max(initial=0)) + 2):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            done = lengths[which] < step
            found.append((which[done], low[done], high[done]))
            which, low, high = which[~done], low[~done], high[~done]
            symbol = patterns[which, lengths[which] - step]
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (which, low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes given by their rows."""
        places, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            known = self.sampled[rows]
            places[todo[known]] = self.places[self.sampled.rank(rows[known])] + steps
            todo, rows = todo[~known], rows[~known]
            symbol = self.wavelet[rows]
            rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return places
