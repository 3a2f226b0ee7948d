"""Elias-Fano sequences and an n-gram trie of them, in memory-mapped levels."""

from __future__ import annotations

import tempfile

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence of integers below 2^62: low bits packed, high bits in unary.

    The unary part has its set-bit counts before each word as a directory, so
    any element is found without decoding others.
    """

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.ranks = size, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 1, dtype=np.uint64)
        np.bitwise_or.at(high, (place >> np.uint64(6)).astype(np.int64), _ONE << (place & np.uint64(63)))
        ones = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.cumsum(ones) - ones)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.low, self.high, self.ranks

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        carry = (self.low[word + 1] << _ONE) << (np.uint64(63) - shift)
        return ((value | carry) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at places i."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.ranks, i, side="right") - 1
        left, bits, at = i - self.ranks[word], self.high[word], np.zeros(len(i), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # select the left-th set bit by halves
            half = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            right = left >= half
            left = np.where(right, left - half, left)
            bits = np.where(right, bits >> np.uint64(width), bits)
            at += np.where(right, width, 0)
        return ((word * 64 + at - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        if not self.size:
            return np.zeros(0, dtype=np.int64)
        bits = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        i = np.arange(self.size)
        return ((np.flatnonzero(bits) - i) << self.low_bits) | self._low(i)


class Trie:
    """N-grams of two levels: contexts, and below each its successors with quantised log-probabilities.

    Pointers from a context to its successors are monotone, and so are the
    successors once each context's number times the vocabulary is added; both
    are Elias-Fano sequences. The levels lie in one temporary file that is
    mapped into memory and vanishes with the trie.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray):
        """Distinct (context, word) pairs in ascending order, with a code each."""
        names, number = np.unique(contexts, return_inverse=True)
        own, place = np.unique(words, return_inverse=True)
        self.vocabulary = max(1, len(own))
        pointers = np.r_[0, np.cumsum(np.bincount(number, minlength=len(names)))] if len(names) else np.zeros(1, np.int64)
        levels = [EliasFano.of(x) for x in (names, own, pointers, number * self.vocabulary + place)]
        self._file = tempfile.TemporaryFile()
        mapped = [EliasFano(x.size, x.low_bits, *(self._map(a) for a in x.arrays())) for x in levels]
        self.contexts, self.words, self.pointers, self.successors = mapped
        self.codes = self._map(np.asarray(codes, dtype=np.uint16))

    def _map(self, x: np.ndarray) -> np.ndarray:
        if not x.size:
            return x
        at = -(-self._file.seek(0, 2) // 8) * 8
        self._file.seek(at)
        self._file.write(x.tobytes())
        self._file.flush()
        return np.memmap(self._file, dtype=x.dtype, mode="r", offset=at, shape=x.shape)

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each pair, 0 where the trie has none."""
        found = np.zeros(len(contexts), dtype=np.uint16)
        names, own = self.contexts.all(), self.words.all()
        if not len(names) or not len(contexts):
            return found
        c, w = (np.minimum(np.searchsorted(a, x), len(a) - 1) for a, x in ((names, contexts), (own, words)))
        ask = np.flatnonzero((names[c] == contexts) & (own[w] == words))
        target = c[ask] * self.vocabulary + w[ask]
        lo, end = self.pointers.get(c[ask]), self.pointers.get(c[ask] + 1)
        hi = end.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):  # the first successor of the context that is not below the target
            mid = (lo[todo] + hi[todo]) >> 1
            below = self.successors.get(mid) < target[todo]
            lo[todo[below]], hi[todo[~below]] = mid[below] + 1, mid[~below]
            todo = todo[lo[todo] < hi[todo]]
        inside = np.flatnonzero(lo < end)
        inside = inside[self.successors.get(lo[inside]) == target[inside]]
        found[ask[inside]] = self.codes[lo[inside]]
        return found
