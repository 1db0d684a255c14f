"""A compressed full-text index over sequences of words: BWT in a wavelet matrix of packed bits.

The sequences are joined by a separator. Suffixes are sorted by doubling; the Burrows-Wheeler transform of the
words' ranks is stored level by level as packed bits with a running count per 64 bits, so the index takes
log2(words) bits a word and a quarter more for the counts. Backward search narrows the suffix interval of many
patterns in lock-step, one word to the left a step: two ranks per level for all patterns at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits and how many ones stand before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bits.dtype)]), bitorder="little").view("<u8")
        self.packed, self.ones = packed, int(bits.sum())
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        low = self.packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Ranks of symbols in a sequence: stable parting by each bit, the highest first."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.height, self.size, self.levels = max(1, int(top).bit_length()), len(symbols), []
        for level in reversed(range(self.height)):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def places(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the bound `at` of the sequence goes when all but `symbol` is parted away."""
        for level, bits in zip(reversed(range(self.height)), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, self.size - bits.ones + ones, at - ones)
        return at


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, the end counting as the least symbol."""
    rank, step, n = text.astype(np.int64) + 1, 1, len(text)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        if new.sum() == n or step >= n:
            return order
        step *= 2


class FMIndex:
    """Sequences of word hashes, in the order given."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """`words`: all sequences one after the other, `sizes`: how many words each has."""
        self.alphabet, symbols = np.unique(words, return_inverse=True)
        text = np.zeros(len(words) + len(sizes) + 1, np.int64)  # 0 parts the sequences and ends the text
        self.begin = np.cumsum(sizes) - sizes + np.arange(len(sizes))
        text[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols + 1
        order = suffix_array(text)
        last = text[order - 1]
        self.wavelet = WaveletMatrix(last, len(self.alphabet))
        self.first = np.searchsorted(np.sort(text), np.arange(len(self.alphabet) + 2))
        #: Where a symbol's run begins after all levels of the matrix.
        every = np.arange(len(self.alphabet) + 1)
        self.origin = self.wavelet.places(every, np.zeros(len(every), np.int64))
        self.size = len(text)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 for those that no sequence has."""
        if not len(self.alphabet):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with `symbol` put before them."""
        shift = self.first[symbol] - self.origin[symbol]
        return self.wavelet.places(symbol, low) + shift, self.wavelet.places(symbol, high) + shift

    def matches(self, words: np.ndarray, ends: np.ndarray, length: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed words, backwards from each of `ends` (exclusive) and up to `length` words.

        How many words before an end occur together at least `least` times, and the suffix interval of those.
        Ends that fail are left behind, so later steps cost less.
        """
        symbol = self.symbols(words)
        matched = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        on = np.arange(len(ends))
        for back in range(1, length + 1):
            on = on[ends[on] >= back]
            on = on[symbol[ends[on] - back] >= 0]
            a, b = self.step(symbol[ends[on] - back], low[on], high[on])
            held = b - a >= least
            on = on[held]
            low[on], high[on], matched[on] = a[held], b[held], back
        return matched, low, high
