"""An FM-index over a sequence of small integers: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; the sequence must end with its only 0."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    rank = np.empty(n, np.int64)
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(starts, place, 0))
    span = width
    # Groups that still tie are sorted by the rank of what follows, over twice the length each time.
    tied = np.flatnonzero(~(starts & np.concatenate([starts[1:], [True]])))
    while len(tied):
        at = order[tied]
        follows = at + span
        second = np.where(follows < n, rank[np.minimum(follows, n - 1)], -1)
        first = rank[at]
        again = np.lexsort((second, first))
        at, first, second = at[again], first[again], second[again]
        order[tied] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        single = new & np.concatenate([new[1:], [True]])
        tied = tied[~single]
        span *= 2
    return order


class WaveletMatrix:
    """Rank and access on a sequence, one bit vector per bit of the alphabet, highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), bits
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = values.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            bit = ((level >> b) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            level = np.concatenate([level[~bit], level[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Number of set bits before i."""
        block, inside = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each i."""
        low = np.zeros_like(i)
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones_low, ones_i = self._ones(level, low), self._ones(level, i)
            low = np.where(bit, self.zeros[level] + ones_low, low - ones_low)
            i = np.where(bit, self.zeros[level] + ones_i, i - ones_i)
        return i - low

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each i, and how often it occurs before."""
        low, symbol = np.zeros_like(i), np.zeros_like(i)
        for level in range(self.bits):
            inside = (i & 63).astype(np.uint64)
            bit = ((self.words[level][i >> 6] >> inside) & np.uint64(1)).astype(np.int64)
            ones_low, ones_i = self._ones(level, low), self._ones(level, i)
            low = np.where(bit, self.zeros[level] + ones_low, low - ones_low)
            i = np.where(bit, self.zeros[level] + ones_i, i - ones_i)
            symbol = (symbol << 1) | bit
        return symbol, i - low


class FMIndex:
    """Counts and places of phrases in a sequence of symbols (1 and up)."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 4):
        text = np.concatenate([symbols, [0]])
        order = suffix_array(text)
        self.n, self.sample = len(text), sample
        self.transform = WaveletMatrix(text[order - 1], max(1, int(alphabet).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])[: alphabet + 1]
        kept = order % sample == 0
        self.is_sampled = kept
        self.sampled_before = np.cumsum(kept) - kept
        self.samples = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of rows of each phrase (a row of ``phrases``), by backward search of all together."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for place in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, place].astype(np.int64)
            low = self.before[symbol] + self.transform.rank(symbol, low)
            high = self.before[symbol] + self.transform.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back until a sampled position."""
        rows, found, steps = rows.astype(np.int64).copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.is_sampled[here]
            found[open_[done]] = self.samples[self.sampled_before[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            symbol, occurrence = self.transform.step(here)
            rows[open_] = self.before[symbol] + occurrence
            steps += 1
        return found
