"""A compressed FM-index of code sequences: ranks on a wavelet matrix, backward search of many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: 64-bit words and the number of ones before each."""

    __slots__ = ("before", "words")

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Ranks of symbols below ``2 ** levels`` in a sequence, one bit vector per level."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels: list[tuple[Bits, int]] = []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            self.levels.append((Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.heads = self.down(np.arange(1 << levels), np.zeros(1 << levels, dtype=np.int64))

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, (bits, zeros) in enumerate(self.levels):
            one = (symbols >> (len(self.levels) - 1 - depth) & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self.down(symbols, at) - self.heads[symbols]


class FmIndex:
    """An index of sequences for patterns of up to ``DEPTH`` symbols.

    Sequences lie one after another, each with a separator 0 behind. Suffixes are ordered by their first ``DEPTH`` symbols, as
    no pattern is longer, which takes five doublings whatever the sequences repeat.
    """

    DEPTH = 32

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, length: int) -> None:
        """``codes`` holds the sequences end to end; patterns are those of ``length`` symbols."""
        if not 16 <= length < self.DEPTH:
            raise ValueError(f"patterns of 16 to {self.DEPTH - 1} symbols")
        self.length, self.lengths = length, lengths
        self.alphabet, symbols = np.unique(codes, return_inverse=True)
        stops = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(codes) + len(lengths), dtype=np.int64)
        body = np.ones(len(text), dtype=bool)
        body[stops] = False
        text[body] = symbols + 1
        self.text, self.stops = text, stops
        ranks = text
        step = 1
        while step < self.DEPTH:
            order, ranks = self.doubled(ranks, step)
            if step == 8:
                sixteen = ranks
            step *= 2
        self.order = order
        # Rows whose first ``length`` symbols are equal: equal at 16 and 16 ending at ``length``.
        head, tail = sixteen[order], self.shifted(sixteen, length - 16)[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        self.groups = np.cumsum(new) - 1
        self.group_starts = np.r_[np.flatnonzero(new), len(order)]
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.first = np.r_[0, np.cumsum(counts)]
        self.matrix = WaveletMatrix(text[order - 1], max(1, len(self.alphabet).bit_length()))

    @staticmethod
    def shifted(ranks: np.ndarray, by: int) -> np.ndarray:
        """The value ``by`` places on; 0 beyond the end."""
        out = np.zeros(len(ranks), dtype=np.int64)
        if by < len(ranks):
            out[: len(ranks) - by] = ranks[by:]
        return out

    @classmethod
    def doubled(cls, ranks: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of suffixes by twice as many symbols, and their ranks in it from 1."""
        keys = ranks * (int(ranks.max(initial=0)) + 2) + cls.shifted(ranks, step)
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        new = np.ones(len(keys), dtype=np.int64)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        out = np.empty(len(keys), dtype=np.int64)
        out[order] = np.cumsum(new)
        return order, out

    def backward(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``symbol + pattern`` from those of each pattern, ``low`` to ``high``; equal ends: it doesn't occur."""
        start = self.first[symbols]
        return start + self.matrix.rank(symbols, low), start + self.matrix.rank(symbols, high)

    def statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the indexed sequences, streamed through the index from their ends, all at once.

        For each place whose match reaches ``length`` symbols: its sequence, its offset, and the group of rows that begin with
        the same symbols. A match is held at ``length``: once longer, it goes to the rows equal in its first ``length``.
        """
        n = len(self.lengths)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(self.text), dtype=np.int64)
        size = np.zeros(n, dtype=np.int64)
        live = np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(1, int(self.lengths.max(initial=0)) + 1):
            live = live[self.lengths[live] >= step]
            low[live], high[live] = self.backward(self.text[self.stops[live] - step], low[live], high[live])
            size[live] += 1
            long = live[size[live] >= self.length]
            if len(long):
                group = self.groups[low[long]]
                low[long], high[long] = self.group_starts[group], self.group_starts[group + 1]
                size[long] = self.length
                found.append((long, self.lengths[long] - step, group))
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(part) for part in zip(*found))

    def least_by_group(self, values: np.ndarray) -> np.ndarray:
        """For each group of rows the least of ``values``, which are given by text position."""
        return np.minimum.reduceat(values[self.order], self.group_starts[:-1])
