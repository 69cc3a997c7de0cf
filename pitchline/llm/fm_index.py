"""A compressed full-text index over sequences of 64-bit words: backward search over a wavelet matrix of the BWT."""

from __future__ import annotations

import numpy as np

from pitchline.llm.text import ragged


class WaveletMatrix:
    """Rank of a symbol in a sequence: one packed bit vector per bit of the symbols, with counts for every 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        n, self.levels = len(symbols), levels
        cells = n // 64 + 1
        self.bits = np.zeros((levels, cells), np.uint64)
        self.counts = np.zeros((levels, cells), np.int64)
        self.zeros = np.zeros(levels, np.int64)
        for level in range(levels):
            bit = ((symbols >> (levels - 1 - level)) & 1).astype(np.uint8)
            packed = np.zeros(cells * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[:len(raw)] = raw
            self.bits[level] = packed.view(np.uint64)
            self.counts[level, 1:] = np.cumsum(np.bitwise_count(self.bits[level]), dtype=np.int64)[:-1]
            self.zeros[level] = n - int(bit.sum())
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` elements' copies of ``symbol`` end in the lowest level."""
        for level in range(self.levels):
            cell = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][cell] + np.bitwise_count(self.bits[level][cell] & mask)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of many sequences (``words`` cut into pieces of ``lengths``), each standing for ``weights`` equal copies.

    Sequences are separated by a symbol that no query holds. Suffixes are sorted on their first ``depth`` words, which
    is enough for queries of at most that length.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray, depth: int) -> None:
        self.alphabet, number = np.unique(words, return_inverse=True)
        self.symbols = number.astype(np.int64) + 1
        at = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(len(words) + len(lengths), np.int64)
        text[at] = self.symbols
        n = len(text)
        rank, k = text, 1
        order = np.argsort(rank, kind="stable")
        while k < depth:
            second = np.zeros(n, np.int64)
            second[:-k] = rank[k:] + 1
            key = rank * (n + 2) + second
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if rank[order[-1]] == n - 1:
                break
            k *= 2
        levels = max(1, int(len(self.alphabet)).bit_length())
        self.wavelet = WaveletMatrix(text[order - 1], levels)
        everything = np.arange(len(self.alphabet) + 1)
        self.base = self.wavelet.place(everything, np.zeros(len(everything), np.int64))
        self.before = np.searchsorted(text[order], everything)
        weight = np.repeat(weights, lengths + 1)[order]
        self.weight = np.concatenate([[0], np.cumsum(weight)])
        self.size = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the queries extended by one symbol to the left."""
        both = self.wavelet.place(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.before[symbol] - self.base[symbol]
        return both[:len(symbol)] + shift, both[len(symbol):] + shift

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[np.maximum(high, low)] - self.weight[low]


def repeated(words: np.ndarray, lengths: np.ndarray, weights: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, first, last): runs of start positions in each sequence whose ``window`` words occur twice or more in all.

    The sequences are indexed, and each is streamed through the index from its right end. For an end e the search
    extends to the left as long as the match occurs twice (its matching statistic); a match of ``window`` words
    or more is reported with all the windows in it. Where the extension stops, words f..e occur once, so windows that
    hold them are done, and the next end is the last one of a window that doesn't. All sequences move together.
    """
    index = FMIndex(words, lengths, weights, int(lengths.max()))
    first = np.cumsum(lengths) - lengths
    lane = np.flatnonzero(lengths >= window)
    end = lengths[lane].copy()
    left, low, high = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), index.size)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(lane):
        new_low, new_high = index.step(index.symbols[first[lane] + left - 1], low, high)
        good = index.occurrences(new_low, new_high) >= 2
        left, low, high = left - good, np.where(good, new_low, low), np.where(good, new_high, high)
        stop = ~good | (left == 0)
        if stop.any():
            at = np.flatnonzero(stop)
            long_ = at[end[at] - left[at] >= window]
            out.append((lane[long_], left[long_], end[long_] - window))
            end[at] = np.minimum(end[at] - 1, left[at] - 1 + window)
            left[at], low[at], high[at] = end[at], 0, index.size
            alive = ~stop | (end >= window)
            if not alive.all():
                lane, end, left, low, high = lane[alive], end[alive], left[alive], low[alive], high[alive]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*out))


def windows_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All start positions of the reported runs."""
    return ragged(first, last - first + 1)
