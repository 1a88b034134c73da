"""Many numbered draws of a text at once: the first 32 bits of MD5 over a prefix and a number, in arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np

CHUNK = 8192  # draws hashed at once, so that their words stay in the cache
LONG = 64  # blocks of a prefix from which hashlib is faster
_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _compress(state: list[np.ndarray], words: np.ndarray, first: bool = False) -> list[np.ndarray]:
    """The state of MD5 after a block, whose sixteen words are the rows of `words`; of the last block only the first word is asked for."""
    a, b, c, d = (s.copy() for s in state)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(61 if first else 64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _K[i]
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        left = _TURN[turn][i % 4]
        np.right_shift(f, np.uint32(32 - left), out=g)
        f <<= np.uint32(left)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    if first:  # what the last three steps would move to the first place
        return [state[0] + b]
    return [s + x for s, x in zip(state, (a, b, c, d), strict=True)]


class Draws:
    """Draws of prefixes, by their places in the list and numbers from 1: hashlib.md5(prefix + b"%d" % number).digest()[:4] as a big-endian number."""

    def __init__(self, prefixes: list[bytes]) -> None:
        self.prefixes = prefixes
        self.size = np.array([len(p) for p in prefixes], np.int64)
        whole = self.size // 64
        self.long = whole > LONG
        self.state = [np.full(len(prefixes), s, np.uint32) for s in _START]
        for k in range(int(whole[~self.long].max(initial=0))):
            has = np.flatnonzero((whole > k) & ~self.long)
            block = np.frombuffer(b"".join(prefixes[i][64 * k : 64 * k + 64] for i in has.tolist()), "<u4").reshape(-1, 16)
            for s, x in zip(self.state, _compress([s[has] for s in self.state], np.ascontiguousarray(block.T)), strict=True):
                s[has] = x
        self.rest = np.frombuffer(b"".join(p[64 * n :].ljust(64, b"\0") if n <= LONG else bytes(64) for p, n in zip(prefixes, whole.tolist(), strict=True)), np.uint8).reshape(-1, 64)

    def __call__(self, row: np.ndarray, number: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.uint32)
        digits = np.searchsorted(10 ** np.arange(1, 19), number, "right") + 1
        kind = np.where(self.long[row], 0, np.where(self.size[row] % 64 + digits + 9 > 64, 2, 1))
        for i in np.flatnonzero(kind == 0).tolist():
            out[i] = int.from_bytes(hashlib.md5(self.prefixes[row[i]] + b"%d" % number[i]).digest()[:4])
        for blocks in (1, 2):
            of = np.flatnonzero(kind == blocks)
            for a in range(0, len(of), CHUNK):
                at = of[a : a + CHUNK]
                out[at] = self._last(row[at], number[at], digits[at], blocks)
        return out

    def _last(self, row: np.ndarray, number: np.ndarray, digits: np.ndarray, blocks: int) -> np.ndarray:
        """Draws whose number ends in the first or second block after the prefix's whole ones."""
        raw = np.zeros((len(row), 64 * blocks), np.uint8)
        raw[:, :64] = self.rest[row]
        end = self.size[row] % 64 + digits
        left, of = number.copy(), np.arange(len(row))
        for k in range(1, int(digits.max()) + 1):
            has = digits >= k if k > 1 else slice(None)
            raw[of[has], end[has] - k] = 48 + left[has] % 10
            left //= 10
        raw[of, end] = 128
        raw[:, -8:] = (8 * (self.size[row] + digits)).astype("<u8").view(np.uint8).reshape(-1, 8)
        words = np.ascontiguousarray(raw.view("<u4").T)
        state = [s[row] for s in self.state]
        if blocks == 2:
            state, words = _compress(state, words[:16]), words[16:]
        return _compress(state, words, first=True)[0].byteswap()
