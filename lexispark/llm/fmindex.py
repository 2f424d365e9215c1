"""A full-text index over sequences of words: Burrows-Wheeler transform, backward search, sampled suffix array."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every separator in `text` is its own symbol, so it ends after log2(longest sequence) rounds."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:-k or None] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Index of several sequences of 64-bit words.

    The transform is held as the sorted positions of each symbol (symbol * n + row in one array), so that one
    binary search is a step of backward search for both its symbol's start and its rank. Of the suffix array
    every `sample`-th text position is kept; other positions are found by walking to the next kept one.
    """

    def __init__(self, sequences: list[np.ndarray], sample: int = 4) -> None:
        m = len(sequences)
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        flat = np.concatenate(sequences) if m else np.zeros(0, np.uint64)
        self.vocabulary, ids = np.unique(flat, return_inverse=True)
        self.n = n = int(self.lengths.sum()) + m
        text = np.empty(n, np.int64)
        is_sep = np.zeros(n, bool)
        is_sep[self.starts + self.lengths] = True
        text[is_sep] = np.arange(m)  # each its own symbol, below all words
        text[~is_sep] = ids + m
        self.first_word = m
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.occurrences = np.sort(self.bwt * n + np.arange(n))
        self.sampled = order % sample == 0
        self.samples = order[self.sampled].astype(np.uint32)
        self.sample_rank = np.cumsum(self.sampled) - 1

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The index's symbols of words; -1 for a word that it doesn't hold."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + self.first_word, -1)

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before `row` that continue to the left with the symbol, as a row of the sorted suffixes."""
        return np.searchsorted(self.occurrences, symbol * self.n + row)

    def backward(self, stream: np.ndarray, rec: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of every run of `least` words of a stream of texts.

        Returns the positions in the stream at which a found run starts, and the interval of suffixes of each.
        """
        q = self.symbols(stream)
        end = np.arange(len(q))
        end = end[(q >= 0) & (end >= least - 1)]
        end = end[rec[end - least + 1] == rec[end]]
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        for k in range(least):
            c = q[end - k]
            lo, hi = self.step(c, lo), self.step(c, hi)
            go = (c >= 0) & (lo < hi)
            end, lo, hi = end[go], lo[go], hi[go]
        return end - least + 1, lo, hi

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and position in it at which the suffixes of these rows start."""
        pos = np.zeros(len(rows), np.int64)
        todo, at, walked = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            kept = self.sampled[at]
            pos[todo[kept]] = (self.samples[self.sample_rank[at[kept]]] + walked) % self.n
            todo, at = todo[~kept], at[~kept]
            at = self.step(self.bwt[at], at)
            walked += 1
        seq = np.searchsorted(self.starts, pos, side="right") - 1
        return seq, pos - self.starts[seq]
