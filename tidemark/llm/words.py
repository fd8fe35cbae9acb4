"""Words of whole texts as NumPy arrays: where they stand, and hashes of single words and of windows of words.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All hashes are polynomials over 64-bit values modulo 2**64 (Rabin-Karp),
taken from prefix sums: with B odd and so invertible, the hash of bytes s..e-1 is (P[e] - P[s]) * B**-s.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B1))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        table = np.ones(size, np.uint64)
        done, step = 1, base % (1 << 64)
        while done < size:  # table[done:2*done] = table[:done] * base**done
            table[done : 2 * done] = table[:done] * np.uint64(step)
            done, step = 2 * done, step * step % (1 << 64)
        have = _powers[base] = table
    return have[:n]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[s:e] for each span, mixed with its length."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=prefix[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)
    raw = (prefix[ends] - prefix[starts]) * back[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _M2)


#: Bytes hashed at a time; only a longer word takes more.
SEGMENT = (1 << 19) - 1


class Corpus:
    """Words of some texts, one after another: ``first[i]`` to ``first[i + 1]`` are those of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if lower:
            data = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
        starts, ends = word_bounds(data)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.words = np.zeros(len(starts), np.uint64)
        s = 0
        while s < len(starts):  # some SEGMENT bytes at a time: prefix sums take tens of bytes for each byte of text
            e = max(s + 1, int(np.searchsorted(ends, starts[s] + SEGMENT, side="right")))
            low = starts[s]
            self.words[s:e] = span_hashes(_byte_values()[data[low : ends[e - 1]]], _B1, starts[s:e] - low, ends[s:e] - low)
            s = e

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words within a text, and the places of their first words."""
        n = np.maximum(self.counts - size + 1, 0)
        at = np.repeat(self.first[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return (span_hashes(self.words, _B2, at, at + size) if len(at) else np.zeros(0, np.uint64)), at


def parts(texts: list[bytes], most: int = 4 << 20):
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
