"""Compressed FM-index over a sequence of integers, with matching statistics by backward search.

Symbols are 0 to sigma - 1; 0 separates texts. What is kept: the BWT as a wavelet matrix (bits and a count
for each 64 of them), and for each depth up to the window one bit a row that says where suffixes begin
to differ within that depth, by which a match is shortened from its right end. The suffix array and the
ranks that build it are dropped. Suffixes are sorted by the first power of two of symbols that is no
less than the window, which is all that patterns up to the window need. All operations take arrays and
advance many searches together.
"""

from __future__ import annotations

import numpy as np

MOST = 31
_ALL = np.uint64((1 << 64) - 1)


def _ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    pair = high.astype(np.int64) * (int(low.max(initial=0)) + 1) + low
    return np.unique(pair, return_inverse=True)[1].reshape(-1)


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:] + 1
    return out


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    some = np.packbits(flags, bitorder="little")
    out[: len(some)] = some
    return out.view(np.uint64)


class WaveletMatrix:
    """Bits of the symbols, highest first, each level packed in 64-bit words with counts before each word."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        v = values.astype(np.int32)
        n = len(v)
        for level in range(self.levels - 1, -1, -1):
            bit = (v >> level & 1).astype(bool)
            words = _packed(bit, n // 64 + 1)
            self.words.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words)[:-1], dtype=np.int64))).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            v = np.concatenate((v[~bit], v[bit]))
        self.bottom = np.searchsorted(_bottom_key(v, self.levels), _bottom_key(np.arange(sigma, dtype=np.int32), self.levels)).astype(np.int32)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for i in range(self.levels):
            word = at >> 6
            ones = self.before[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, at - ones)
        return at - self.bottom[symbol]


def _bottom_key(v: np.ndarray, levels: int) -> np.ndarray:
    """At the lowest level symbols stand in the order of their bits reversed."""
    out = np.zeros_like(v)
    for i in range(levels):
        out |= (v >> i & 1) << (levels - 1 - i)
    return out


class Steps:
    """For each depth the rows whose suffix shares fewer symbols than that with the row above; the end counts as one."""

    def __init__(self, common: np.ndarray, most: int):
        words = len(common) // 64 + 1
        self.bits = np.zeros((most + 1, words), np.uint64)
        for d in range(1, most + 1):
            self.bits[d] = _packed(common < d, words)
        some, at = self.bits != 0, np.arange(words, dtype=np.int32)
        self._last = np.maximum.accumulate(np.where(some, at, 0), axis=1)
        self._next = np.minimum.accumulate(np.where(some, at, words - 1)[:, ::-1], axis=1)[:, ::-1]

    def at_or_before(self, depth: np.ndarray, row: np.ndarray) -> np.ndarray:
        w = row >> 6
        bits = self.bits[depth, w] & (_ALL >> (63 - (row & 63)).astype(np.uint64))
        far = bits == 0
        w = np.where(far, self._last[depth, np.maximum(w - 1, 0)], w)
        bits = np.where(far, self.bits[depth, w], bits)
        for by in (1, 2, 4, 8, 16, 32):
            bits = bits | bits >> np.uint64(by)
        return (w << 6) + np.bitwise_count(bits) - 1

    def at_or_after(self, depth: np.ndarray, row: np.ndarray) -> np.ndarray:
        w = row >> 6
        bits = self.bits[depth, w] & (_ALL << (row & 63).astype(np.uint64))
        far = bits == 0
        w = np.where(far, self._next[depth, np.minimum(w + 1, self.bits.shape[1] - 1)], w)
        bits = np.where(far, self.bits[depth, w], bits)
        with np.errstate(over="ignore"):
            return (w << 6) + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))


class FMIndex:
    def __init__(self, text: np.ndarray, window: int):
        if not 1 <= window <= MOST:
            raise ValueError(f"windows have 1 to {MOST} symbols")
        ranks = [text.astype(np.int64)]
        while 1 << (len(ranks) - 1) < window:
            ranks.append(_ranked(ranks[-1], _shifted(ranks[-1], 1 << (len(ranks) - 1))))
        rows = np.argsort(ranks[-1], kind="stable")
        self.size, self.window = len(rows), window
        a, b = rows[:-1].copy(), rows[1:].copy()
        common = np.zeros(self.size + 1, np.uint8)
        for k in range(len(ranks) - 1, -1, -1):
            of = np.append(ranks[k], -1)  # only one of two places can be the end
            same = (of[np.minimum(a, self.size)] == of[np.minimum(b, self.size)]) & (a < self.size) & (b < self.size)
            step = same.astype(np.int64) << k
            a, b = a + step, b + step
            common[1:-1] += step.astype(np.uint8)
        common = np.minimum(common, window)
        sigma = int(text.max(initial=0)) + 1
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.bwt = WaveletMatrix(text[rows - 1], sigma)
        self.common, self.steps = common, Steps(common, window)

    def all(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the empty pattern, n times."""
        return np.zeros(n, np.int64), np.full(n, self.size, np.int64)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the intervals of symbol + pattern; empty ones for symbols that the index lacks."""
        known = symbol < len(self.below) - 1
        s = np.where(known, symbol, 0)
        both = self.bwt.rank(np.concatenate((s, s)), np.concatenate((lo, hi))) + np.concatenate((self.below[s],) * 2)
        return np.where(known, both[: len(lo)], 0), np.where(known, both[len(lo) :], 0)

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The length to which a match has to be shortened before its interval grows."""
        return np.maximum(self.common[lo], self.common[hi]).astype(np.int64)

    def shortened(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``length`` symbols of patterns."""
        none = length == 0
        d = np.maximum(length, 1)
        return np.where(none, 0, self.steps.at_or_before(d, lo)), np.where(none, self.size, self.steps.at_or_after(d, hi))


def window_matches(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where in text[begin:end] of each lane a window starts that the indexed text has, by matching statistics.

    Lanes are read from their ends. Of each place the longest match that begins there, up to the window,
    follows from that of the place behind it: it grows by the symbol or is shortened from the right until
    it can. A lane stops once what is left of it and its match are shorter than a window.
    """
    out = np.zeros(len(text), bool)
    begin, at = begin.astype(np.int64), end.astype(np.int64).copy()
    lo, hi = index.all(len(at))
    length = np.zeros(len(at), np.int64)
    while True:
        live = at - begin + length >= index.window
        live &= at > begin
        if not live.all():
            begin, at, lo, hi, length = begin[live], at[live], lo[live], hi[live], length[live]
        if not len(at):
            return out
        a, b = index.extend(lo, hi, text[at - 1])
        grown = a < b
        lo, hi = np.where(grown, a, lo), np.where(grown, b, hi)
        length += grown
        at -= grown | (length == 0)  # a symbol that the index lacks is passed over
        whole = length == index.window
        out[at[whole]] = True
        short = np.flatnonzero(whole | ~grown & (length > 0))
        length[short] = np.where(whole[short], index.window - 1, index.parent(lo[short], hi[short]))
        lo[short], hi[short] = index.shortened(lo[short], hi[short], length[short])
