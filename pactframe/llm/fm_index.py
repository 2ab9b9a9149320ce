"""A compressed FM-index over sequences of words, for one shard.

The Burrows-Wheeler transform is held in a wavelet matrix: one bit vector per bit of a word's code, packed
into 64-bit words with a running count for each, so about 1.5 bits a bit. Suffixes are sorted by their first
`depth` words, which is all that patterns of up to `depth` words need. Where the suffixes that share their
first k words begin is one bit vector for each k, too.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask).astype(np.int64)

    def place(self, k: np.ndarray) -> np.ndarray:
        """Where the set bit number k (from 0) is; the length where there is none."""
        at = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[at]
        word, found = self.words[at], at << 6
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left = left - np.where(up, low, 0)
            word = np.where(up, word >> np.uint64(half), word)
            found = found + np.where(up, half, 0)
        return np.minimum(found, self.n)


class WaveletMatrix:
    def __init__(self, codes: np.ndarray, sigma: int):
        self.levels: list[tuple[BitVector, int]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bits = (codes >> shift & 1).astype(np.uint8)
            self.levels.append((BitVector(bits), len(bits) - int(bits.sum())))
            codes = np.concatenate((codes[bits == 0], codes[bits == 1]))
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        shift = len(self.levels)
        for bits, zeros in self.levels:
            shift -= 1
            ones = bits.ones(i)
            i = np.where(c >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often code c is among the first i."""
        return self._descend(c, i) - self.first[c]


class FMIndex:
    """Index of `sequences` (lists of codes from 1 on). owner: a number per sequence."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int):
        """codes: all sequences one after the other; lengths: of each."""
        self.depth = depth
        n = len(codes) + len(lengths)
        text = np.zeros(n + depth + 1, np.int64)
        text[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
        self.sigma = int(codes.max(initial=0)) + 1
        order = self._sorted_suffixes(text, n)
        self.wavelet = WaveletMatrix(text[order - 1], self.sigma)  # the last place of text is padding, a zero
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text[:n], minlength=self.sigma))))[:-1]
        lcp = self._common(text, order)
        whole = np.flatnonzero(lcp < depth)
        of_sequence = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.least = np.minimum.reduceat(owner[of_sequence[order]], whole) if n else owner[:0]
        self.begins = [BitVector(lcp < k) for k in range(depth + 1)]
        self.n = n

    def _sorted_suffixes(self, text: np.ndarray, n: int) -> np.ndarray:
        rank, reach = text.copy(), 1
        while reach < self.depth:
            shifted = np.zeros_like(rank)
            shifted[:-reach] = rank[reach:]
            rank = np.unique(rank * (int(rank.max()) + 1) + shifted, return_inverse=True)[1].reshape(-1)
            reach *= 2
        return np.argsort(rank[:n], kind="stable")

    def _common(self, text: np.ndarray, order: np.ndarray) -> np.ndarray:
        """How many words, up to depth, each suffix shares with the one before it."""
        lcp = np.zeros(len(order), np.int8)
        same = np.ones(max(0, len(order) - 1), bool)
        for j in range(self.depth):
            at = text[order + j]
            same &= at[1:] == at[:-1]
            lcp[1:] += same
        return lcp

    def _shrink(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray, at: np.ndarray) -> None:
        """At places `at`, the last word of the match is given up."""
        length[at] -= 1
        for d in np.unique(length[at]):
            some = at[length[at] == d]
            if d == 0:
                lo[some], hi[some] = 0, self.n
            else:
                begins = self.begins[int(d)]
                run = begins.ones(lo[some] + 1)
                lo[some], hi[some] = begins.place(run - 1), begins.place(run)

    def matching_statistics(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the patterns, the words (up to depth) that match from there on, and the place in suffix order.

        All patterns are searched backward at once. When a word cannot be put before the match, or the match is
        at full depth, it gives up its last word. Codes that are not in the index are -1.
        """
        offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        found, where = np.zeros(len(codes), np.int8), np.zeros(len(codes), np.int64)
        q = len(lengths)
        lo, hi, length = np.zeros(q, np.int64), np.full(q, self.n, np.int64), np.zeros(q, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > step)
            place = offsets[live] + lengths[live] - 1 - step
            word = codes[place]
            lost = live[(word < 0) | (word >= self.sigma)]
            lo[lost], hi[lost], length[lost] = 0, self.n, 0
            todo, code = live, word
            known = (word >= 0) & (word < self.sigma)
            todo, code = todo[known], code[known]
            full = todo[length[todo] == self.depth]
            if len(full):
                self._shrink(lo, hi, length, full)
            while len(todo):
                ranks = self.wavelet.rank(np.concatenate((code, code)), np.concatenate((lo[todo], hi[todo])))
                new_lo, new_hi = self.starts[code] + ranks[: len(todo)], self.starts[code] + ranks[len(todo) :]
                good = new_lo < new_hi
                lo[todo[good]], hi[todo[good]] = new_lo[good], new_hi[good]
                length[todo[good]] += 1
                todo, code = todo[~good], code[~good]
                more = length[todo] > 0
                todo, code = todo[more], code[more]
                if len(todo):
                    self._shrink(lo, hi, length, todo)
            found[place], where[place] = length[live], lo[live]
        return found, where

    def least_owner(self, where: np.ndarray) -> np.ndarray:
        """The least owner of the sequences that hold the full-depth match at these places."""
        return self.least[self.begins[self.depth].ones(where + 1) - 1]
