"""A compressed FM-index over rows of words: suffix array, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(ranks: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes, by doubling; suffixes differ within longest places."""
    n, k = len(ranks), 1
    order = np.argsort(ranks, kind="stable")
    while True:
        ordered = ranks[order]
        place = np.empty(n, np.int64)
        if k == 1:
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        else:
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])  # noqa: F821
        place[order] = new
        if new[-1] == n - 1 or k > longest:
            return order
        following = np.zeros(n, np.int64)
        following[:-k] = place[k:] + 1
        key = place * (n + 1) + following
        order = np.argsort(key, kind="stable")
        k *= 2


class WaveletMatrix:
    """Rank of a symbol before a place, a bit vector of 64-bit words and their counts per level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        self.bits = max(int(size - 1).bit_length(), 1)
        left = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (left >> level & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            zeros = len(bit) - int(counts[-1])
            self.levels.append((level, words, counts, zeros))
            left = np.concatenate([left[bit == 0], left[bit == 1]])
        # where each symbol's run begins on the last level
        self.first = np.zeros(size, np.int64)
        values, at = np.unique(left, return_index=True)
        self.first[values] = at

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often symbol stands before place."""
        place = place.copy()
        for level, words, counts, zeros in self.levels:
            block, inside = place >> 6, (place & 63).astype(np.uint64)
            below = words[block] & ((np.uint64(1) << inside) - np.uint64(1))
            ones = counts[block] + np.bitwise_count(below)
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place - self.first[symbol]


class Index:
    """An index of rows of words (hashes), each with a weight: how often it stands in the corpus."""

    def __init__(self, rows: list[np.ndarray], weights: np.ndarray):
        sizes = np.array([len(r) for r in rows], np.int64)
        self.words, symbol = np.unique(np.concatenate(rows), return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        n = int(sizes.sum()) + len(rows)
        self.text = np.zeros(n, np.int64)  # 0 closes a row
        inside = np.ones(n, bool)
        inside[self.begin + sizes] = False
        self.text[inside] = symbol + 1
        ranks = self.text + len(rows)
        ranks[~inside] = np.arange(len(rows))  # each close is a symbol of its own, so suffixes differ
        order = suffix_array(ranks, int(sizes.max()) + 1)
        self.size = len(self.words) + 1
        self.before = WaveletMatrix(self.text[order - 1], self.size)
        counts = np.bincount(self.text, minlength=self.size)
        self.starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.ends = self.starts + counts
        owner = np.repeat(np.arange(len(rows)), sizes + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])

    def match(self, end: np.ndarray, most: int) -> np.ndarray:
        """Matching statistics: words before each place of the text that stand together at least twice
        in the corpus, by backward search; at most most."""
        length = np.zeros(len(end), np.int64)
        active = np.arange(len(end))
        symbol = self.text[end - 1]
        low, high = self.starts[symbol], self.ends[symbol]
        for step in range(1, most + 1):
            twice = self.weight[high] - self.weight[low] >= 2
            active, low, high = active[twice], low[twice], high[twice]
            length[active] = step
            if step == most or not len(active):
                break
            symbol = self.text[end[active] - 1 - step]
            low = self.starts[symbol] + self.before.rank(symbol, low)
            high = self.starts[symbol] + self.before.rank(symbol, high)
        return length


def repeated_windows(rows: list[np.ndarray], weights: np.ndarray, window: int) -> np.ndarray:
    """For each row a bit mask of its windows (bit i: begins at word i) that stand at least twice.

    Rows are streamed through the index of all rows. A row of a weight of two or more is repeated
    as a whole. A search that stops short at a word rules out all windows that hold the words seen.
    """
    counts = np.array([len(r) - window + 1 for r in rows], np.int64)
    masks = np.where(weights >= 2, (1 << counts) - 1, 0)
    todo = np.flatnonzero(weights < 2)
    if not len(todo):
        return masks
    index = Index(rows, weights)
    at = np.zeros(len(rows), np.int64)
    while len(todo):
        length = index.match(index.begin[todo] + at[todo] + window, window)
        full = length == window
        masks[todo[full]] |= 1 << at[todo[full]]
        # the word left of the match: windows up to it hold that word and the match
        at[todo] += np.where(full, 1, window - length)
        todo = todo[at[todo] < counts[todo]]
    return masks
