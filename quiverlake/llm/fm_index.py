"""An FM-index over integer symbols: suffix array by doubling, the Burrows-Wheeler transform in a
wavelet matrix of packed bits, and backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Ranks of symbols 0..sigma-1 in a sequence, by a wavelet matrix."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            one = (values >> level) & 1
            self.bits.append(Bits(one.astype(np.uint8)))
            self.zeros.append(int(len(values) - one.sum()))
            values = np.concatenate([values[one == 0], values[one == 1]])
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            ones = self.bits[k].rank(p)
            p = np.where((c >> level) & 1 == 1, self.zeros[k] + ones, p - ones)
        return p

    def rank(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often c comes before place p."""
        return self._walk(c, p) - self.first[c]


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (0 at ends only), compared to at least depth symbols; each 0 is a symbol of its own."""
    n = len(text)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order, k = np.argsort(rank, kind="stable"), 1
    _, rank = np.unique(rank, return_inverse=True)
    while k < depth and rank[order[-1]] != n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
    return order


class FMIndex:
    """Of pieces of symbols (1..sigma-1), one after another, each ended by a 0."""

    def __init__(self, pieces: np.ndarray, sizes: np.ndarray, sigma: int):
        stops = np.cumsum(sizes + 1) - 1
        text = np.zeros(len(pieces) + len(sizes), np.int64)
        inside = np.ones(len(text), bool)
        inside[stops] = False
        text[inside] = pieces
        self.sa = suffix_array(text, stops, int(sizes.max(initial=0)) + 1)
        self.piece = np.repeat(np.arange(len(sizes)), sizes + 1)[self.sa]
        self.count = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))
        self.wavelet = Wavelet(text[self.sa - 1], sigma)

    def _step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of what was read with c before it."""
        both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.count[c] + both[: len(c)], self.count[c] + both[len(c) :]

    def matches(self, text: np.ndarray, sizes: np.ndarray, label: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the indexed pieces among those of smaller labels: piece, begin and end of each match of `least` or more.

        A piece is read backwards from an end; its interval shrinks with each symbol, and the least label in it
        tells if a smaller piece still has what was read. Where it hasn't, the match is as long as it gets, and the next
        end is one before. A piece that is matched to its beginning is done: what ends earlier lies within.
        """
        minimum = Minimum(label[self.piece])
        first = np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes >= least)
        end = sizes[live].copy()
        at, lo, hi = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), len(self.sa), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        while len(live):
            lo2, hi2 = self._step(text[first[live] + at - 1], lo, hi)
            more = hi2 > lo2
            more[more] = minimum.of(lo2[more], hi2[more]) < label[live[more]]
            at[more] -= 1
            lo[more], hi[more] = lo2[more], hi2[more]
            over = ~more | (at == 0)
            report = over & (end - at >= least)
            found.append((live[report], at[report].copy(), end[report].copy()))
            back = np.flatnonzero(~more)
            end[back] -= 1
            at[back], lo[back], hi[back] = end[back], 0, len(self.sa)
            stay = (at > 0) & (end >= least)
            live, end, at, lo, hi = live[stay], end[stay], at[stay], lo[stay], hi[stay]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array interval of each row of patterns; where nothing is found it is empty."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.sa), np.int64)
        live = np.arange(m)
        for j in reversed(range(width)):
            lo[live], hi[live] = self._step(patterns[live, j], lo[live], hi[live])
            live = live[hi[live] > lo[live]]
        return lo, hi


class Minimum:
    """The least value in any range, by a table of ranges of each power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.int32)]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of lo..hi, which aren't empty."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            out[some] = np.minimum(self.levels[k][lo[some]], self.levels[k][hi[some] - (1 << k)])
        return out
