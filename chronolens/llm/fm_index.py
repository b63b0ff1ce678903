"""FM-index of a shard of words: backward search through wavelet-tree ranks, location by sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet tree, level by level (as a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1 != 0
            self.levels.append((shift, Bits(bit), int(len(bit) - np.count_nonzero(bit))))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols."""
        low = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (c >> shift) & 1 != 0
            a, b = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
        return i - low

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one, before = bits.get(i), bits.rank(i)
            out |= one.astype(out.dtype) << shift
            i = np.where(one, zeros + before, i - before)
        return out


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling from triples.

    The last rank must occur once: then no comparison runs over the end.
    """
    n = len(ranks)
    rank, width = ranks.astype(np.int64), int(ranks.max()) + 2
    ahead = lambda x, h: np.concatenate((x[h:] + 1, np.zeros(min(h, n), dtype=np.int64)))
    h = 1
    if width < 1 << 20:
        key, h = (rank * width + ahead(rank, 1)[:n]) * width + ahead(rank, 2)[:n], 3
    else:
        key = rank
    while True:
        order = np.argsort(key, kind="stable")
        at = key[order]
        new = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        key = rank * (n + 1) + ahead(rank, h)[:n]
        h *= 2


class FMIndex:
    """symbols: 0 is a gap, which nothing matches; words are 1..largest. The last symbol must be a gap."""

    def __init__(self, symbols: np.ndarray, largest: int):
        gaps = symbols == 0
        n_gaps = int(np.count_nonzero(gaps))
        order = suffix_array(np.where(gaps, np.cumsum(gaps) - 1, symbols + n_gaps))
        before = np.concatenate(([0], symbols[:-1]))
        self.bwt = Wavelet(before[order].astype(np.int64), largest)
        counts = np.bincount(symbols[~gaps], minlength=largest + 1)
        self.first = np.zeros(largest + 2, dtype=np.int64)
        np.cumsum(counts, out=self.first[1:])
        self.first += n_gaps  # first[c] is the first row of suffixes that begin with c, for c >= 1
        kept = (before[order] == 0) | (order % SAMPLE == 0)
        self.kept, self.samples = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns (one a row, left-aligned) that occur: their row numbers, first and last rows (exclusive) of the index."""
        live = np.arange(len(patterns))
        c = patterns[live, lengths - 1]
        low, high = self.first[c], self.first[c + 1]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 2
        while len(live):
            keep = high > low
            live, low, high = live[keep], low[keep], high[keep]
            over = lengths[live] < step
            if over.any():
                done.append((live[over], low[over], high[over]))
                live, low, high = live[~over], low[~over], high[~over]
            c = patterns[live, lengths[live] - step]
            low, high = (self.first[c] + self.bwt.rank(c, x) for x in (low, high))
            step += 1
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (live, live, live)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows."""
        out = np.zeros(len(rows), dtype=np.int64)
        at, steps = np.arange(len(rows)), 0
        while len(rows):
            found = self.kept.get(rows)
            out[at[found]] = self.samples[self.kept.rank(rows[found])] + steps
            rows, at = rows[~found], at[~found]
            c = self.bwt.get(rows)
            rows = self.first[c] + self.bwt.rank(c, rows)
            steps += 1
        return out
