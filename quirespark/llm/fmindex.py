"""A word-level FM-index in numpy: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions.

The text is an array of word ids; 0 is a separator, which no phrase holds. Every
separator sorts as a symbol of its own, so sorting stops at it, and the position after
each one is sampled, so a walk back from an occurrence never passes one.
"""

from __future__ import annotations

import io

import numpy as np

#: Positions between two samples at most.
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes: by as many words as fit a number at first, then by prefix doubling of those that are still alike."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.cumsum(text == 0)
    value = np.where(text == 0, ends, text.astype(np.int64) + ends[-1])  # from 1; beyond the end 0
    bits = int(value.max()).bit_length()
    k = max(1, 62 // bits)
    padded, key = np.r_[value, np.zeros(k, np.int64)], np.zeros(n, np.int64)
    for i in range(k):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key)
    rank, at = np.full(n + 1, -1, np.int64), np.arange(n)
    first = np.r_[True, np.diff(key[order]) != 0]
    start = np.maximum.accumulate(np.where(first, at, 0))  # a rank is the place of the first suffix alike
    rank[order] = start
    alike = np.nonzero(~(first & np.r_[first[1:], True]))[0]
    while alike.size:
        own = order[alike]
        key = start[alike] * (n + 1) + rank[np.minimum(own + k, n)] + 1
        by = np.argsort(key)
        own, key = own[by], key[by]
        first = np.r_[True, np.diff(key) != 0]
        order[alike] = own
        start[alike] = alike[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        rank[own] = start[alike]
        alike = alike[~(first & np.r_[first[1:], True])]
        k *= 2
    return order


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, one bit more at least."""
    padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Index:
    """FM-index of a text of word ids (from 1 to symbols, 0 between runs; the last id is 0): what of() makes and dump() keeps."""

    def __init__(self, n: int, counts: np.ndarray, levels: np.ndarray, sampled: np.ndarray, samples: np.ndarray):
        self.n, self.counts, self.samples = n, counts, samples
        self.first = np.r_[0, np.cumsum(counts)[:-1]]
        self.sampled = Bits(sampled)
        bits = [Bits(x) for x in levels]
        self.levels = [(len(bits) - 1 - i, b, n - int(b.before[-1])) for i, b in enumerate(bits)]
        self.zero = self._start(np.arange(len(counts)))

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> Index:
        sa = suffix_array(text)
        n, levels = len(text), []
        seq = text[sa - 1] if n else text
        for shift in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bit = seq >> shift & 1
            levels.append(packed(bit))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        begins = np.r_[True, text[:-1] == 0] if n else np.zeros(0, bool)
        sampled = (begins | (np.arange(n) % SAMPLE == 0))[sa]
        return cls(n, np.bincount(text, minlength=symbols + 1), np.stack(levels), packed(sampled), sa[sampled].astype(np.int32))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, n=self.n, counts=self.counts.astype(np.int32), levels=np.stack([b.words for _, b, _ in self.levels]), sampled=self.sampled.words, samples=self.samples)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        with np.load(io.BytesIO(raw)) as z:
            return cls(int(z["n"]), z["counts"].astype(np.int64), z["levels"], z["sampled"], z["samples"])

    def _start(self, c: np.ndarray) -> np.ndarray:
        at = np.zeros(len(c), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.ones(at)
            at = np.where(c >> shift & 1, zeros + one, at - one)
        return at

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i of the transform."""
        at = i
        for shift, bits, zeros in self.levels:
            one = bits.ones(at)
            at = np.where(c >> shift & 1, zeros + one, at - one)
        return at - self.zero[c]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one position earlier."""
        at, c = row, np.zeros(len(row), np.int64)
        for shift, bits, zeros in self.levels:
            one, b = bits.ones(at), bits.get(at)
            at = np.where(b, zeros + one, at - one)
            c |= b.astype(np.int64) << shift
        return self.first[c] + at - self.zero[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of those rows of `phrases` (all of one length) that occur."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, k]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            some = lo < hi
            which, lo, hi = which[some], lo[some], hi[some]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, left, rows = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        for gone in range(SAMPLE + 1):
            hit = self.sampled.get(rows)
            out[left[hit]] = self.samples[self.sampled.ones(rows[hit])] + gone
            left, rows = left[~hit], rows[~hit]
            if not left.size:
                break
            rows = self.back(rows)
        return out
