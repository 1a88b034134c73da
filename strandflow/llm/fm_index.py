"""A compressed FM-index over word symbols: wavelet matrix of the Burrows-Wheeler transform, array-wise backward search.

Suffixes are ordered by their first ORDER symbols, which keeps backward search exact for patterns of up to ORDER symbols:
rows with a common prefix of fewer symbols form one run, and the rows that a step counts are before or in that run.

A symbol costs a bit and a half a level of the wavelet matrix, 12 bytes of run borders (what dropping a pattern's last symbol needs) and 8 for each
different window; the suffix order is not kept.
"""

from __future__ import annotations

import numpy as np

ORDER = 16
NOWHERE = np.iinfo(np.int64).max


class WaveletMatrix:
    """Ranks of symbols by one bit array a level, packed into 64-bit words with running counts of the zeros."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(symbols)
        words = self.n // 64 + 1
        self.bits, self.ones, self.zeros = [], [], []
        x = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((x >> np.uint32(level)) & np.uint32(1)).astype(np.uint8)
            padded = np.zeros(words * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.zeros(words + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=ones[1:], dtype=np.int32)
            self.bits.append(packed)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        below = self.bits[level][word] & ((np.uint64(1) << low) - np.uint64(1))
        return self.ones[level][word] + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `at` symbols."""
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self._rank1(k, start), self._rank1(k, end)
            start = np.where(one, self.zeros[k] + a, start - a)
            end = np.where(one, self.zeros[k] + b, end - b)
        return end - start


class FmIndex:
    """Over texts of symbols 1..sigma-1; 0 ends each text. owner: a number for each text, of which ranges give the least."""

    def __init__(self, symbols: np.ndarray, sigma: int, owner: np.ndarray, window: int) -> None:
        """symbols: the texts with their ends; owner: for each symbol. window: the pattern length that matters, up to ORDER."""
        n = len(symbols)
        ranks = {1: symbols.astype(np.int64)}
        k = 1
        while k < ORDER:
            ranks[2 * k] = self._join(ranks[k], ranks[k], k)
            k *= 2
        order = np.argsort(ranks[ORDER], kind="stable")
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.bwt = WaveletMatrix(symbols[order - 1], sigma)
        self.window, self.n = window, n

        def groups(length: int) -> tuple[np.ndarray, np.ndarray]:
            """Start and end of each row's run of rows with the same `length` first symbols."""
            out, done = None, 0
            for p in (16, 8, 4, 2, 1):
                if length - done >= p:
                    out = ranks[p] if out is None else self._join(out, ranks[p], done)
                    done += p
            g = out[order]
            new = np.ones(n, bool)
            new[1:] = g[1:] != g[:-1]
            first = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            return first[run].astype(np.int32), np.append(first[1:], n)[run].astype(np.int32)

        self.start, self.end = groups(window - 1)
        first, _ = groups(window)
        new = np.diff(first, prepend=-1) != 0
        # the least owner of each run of rows, once, and the run of each row
        self.run = (np.cumsum(new) - 1).astype(np.int32)
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if n else owner

    @staticmethod
    def _join(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """Dense order of the pairs of a at each place and b `shift` places on."""
        n = len(a)
        key = a * (int(b.max(initial=0)) + 2)
        if shift < n:
            key[: n - shift] += b[shift:] + 1
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    def match(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Matching statistics, capped at the window: for each window of each pattern (in order of patterns, then of places) the
        least owner of the texts that hold the window, or the largest integer where none does. Symbol 0 matches nothing.

        A pattern is read from its end; once `window` symbols match, the last one is dropped before the next is
        added, so each symbol costs one backward step. Patterns that the texts do not hold in one piece leave that path at their
        first mismatch, and their remaining windows are searched one by one."""
        w = self.window
        count = np.maximum(lengths - w + 1, 0)
        base = np.concatenate([[0], np.cumsum(count)])
        out = np.full(base[-1], NOWHERE)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        live, left = np.flatnonzero(count), []
        for t in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > t]
            ok, a, b = self._step(symbols[starts[live] + lengths[live] - 1 - t], lo[live], hi[live])
            lost = live[~ok]
            # windows from this place back to the pattern's start are open; those right of it are known or hold the mismatch
            left.append((lost, np.minimum(lengths[lost] - t, count[lost])))
            live = live[ok]
            lo[live], hi[live] = a[ok], b[ok]
            if t >= w - 1:
                out[base[live] + lengths[live] - 1 - t] = self.least[self.run[lo[live]]]
                lo[live], hi[live] = self.start[lo[live]], self.end[lo[live]]
        lost, number = (np.concatenate(x).astype(np.int64) for x in zip(*left, strict=True)) if left else (np.zeros(0, np.int64),) * 2
        place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        slot, begin = np.repeat(base[lost], number) + place, np.repeat(starts[lost], number) + place
        lo, hi = np.zeros(len(slot), np.int64), np.full(len(slot), self.n, np.int64)
        for t in range(w - 1, -1, -1):
            ok, lo, hi = self._step(symbols[begin + t], lo, hi)
            slot, begin, lo, hi = slot[ok], begin[ok], lo[ok], hi[ok]
        out[slot] = self.least[self.run[lo]]
        return out

    def _step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether some row is left, start, end) of the rows with c before the rows [lo, hi)'s prefix."""
        known = (c > 0) & (c < len(self.counts) - 1)
        c = np.where(known, c, 0)
        a, b = self.counts[c] + self.bwt.rank(c, lo), self.counts[c] + self.bwt.rank(c, hi)
        return known & (b > a), a, b
