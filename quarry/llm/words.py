"""Words, hashes of words and windows over UTF-8 bytes, all rows of a block at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for range hashes out of prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes 0x20 and 0x09 to 0x0D, the only ones that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: First bytes of UTF-8 sequences: one for each code point.
HEAD = (np.arange(256) & 0xC0) != 0x80
SALT = np.random.default_rng(20_240_131).integers(1, 2**63, size=(2, 256), dtype=np.uint64) * U(2) + U(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64; grows as needed and is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        out[1:] = U(base)
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Ranges:
    """64-bit hashes of any byte ranges of a block, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(SALT[salt][data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses a row's border."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border[0] = border[n] = True
    start = inside & border[:n]
    start[1:] |= inside[1:] & ~inside[:-1]
    end = inside & border[1:]
    end[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` and the first word of each row (one more than rows)."""
    start, end = runs(~SPACE[data], offsets)
    return start, end, np.searchsorted(start, offsets)


def totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a block's byte flags for each row."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def combine(*hashes: np.ndarray) -> np.ndarray:
    """One hash of several in order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * U(0x2545F4914F6CDD1D) + h)
    return out
