"""FM-index over a shard of text: suffix array, wavelet matrix of its BWT, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16  # every so many text positions are kept
CHUNK = 1 << 18  # rows located at a time


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array of ``codes`` (last code 0, found nowhere else), by prefix doubling.

    The first round sorts by as many codes as fit into 62 bits; later rounds sort only the
    suffixes that still share their rank with another one.
    """
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)]).astype(np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    slots = np.arange(n)
    sorted_keys = key[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    step = width
    while True:
        first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        group = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        rank[order[slots]] = group
        alone = first & np.r_[first[1:], True]
        slots = slots[~alone]
        if not len(slots):
            return order
        suffixes = order[slots]
        sorted_keys = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + step, n)] + 1
        by = np.argsort(sorted_keys)
        order[slots] = suffixes[by]
        sorted_keys = sorted_keys[by]
        step *= 2


class _Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place ``i``."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FMIndex:
    """Counts and locates phrases of codes in one sequence of codes (all above 0)."""

    def __init__(self, codes: np.ndarray):
        text = np.concatenate([codes, np.zeros(1, codes.dtype)]).astype(np.int64)
        order = suffix_array(text)
        self.length = len(text)
        self.bwt = text[order - 1]
        self.size = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        kept = order % SAMPLE == 0
        self.sampled = _Bits(kept)
        self.is_sampled = kept
        self.samples = order[kept]
        self.levels: list[tuple[int, int, _Bits]] = []
        level = self.bwt
        for shift in range(max(1, (self.size - 1).bit_length()) - 1, -1, -1):
            bits = (level >> shift) & 1 == 1
            self.levels.append((shift, int(len(bits) - bits.sum()), _Bits(bits)))
            level = np.concatenate([level[~bits], level[bits]])
        symbols = np.arange(self.size)
        self.base = self._descend(symbols, np.zeros(self.size, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, zeros, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``i`` of the BWT."""
        return self._descend(symbol, i) - self.base[symbol]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges after one more symbol in front."""
        both = self._descend(np.r_[symbol, symbol], np.r_[low, high]) - np.tile(self.base[symbol] - self.first[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of ``phrases`` (one per row, equally long), by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.length, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            low, high = self.step(c, low, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of ``rows``, by walking back to the next sampled position."""
        out = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), CHUNK):
            row = rows[at : at + CHUNK].copy()
            steps = np.zeros(len(row), np.int64)
            walking = np.flatnonzero(~self.is_sampled[row])
            while len(walking):
                r = row[walking]
                c = self.bwt[r]
                row[walking] = self.first[c] + self.rank(c, r)
                steps[walking] += 1
                walking = walking[~self.is_sampled[row[walking]]]
            out[at : at + CHUNK] = self.samples[self.sampled.rank(row)] + steps
        return out
