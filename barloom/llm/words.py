"""Words of many texts at once, as 64-bit hashes, in numpy.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased.  A word's hash is a polynomial in an odd
base over random values of its bytes (mod 2**64), taken from one running sum over the batch, then mixed.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    lower = np.arange(256)
    lower[65:91] += 32
    return mix((lower.astype(np.uint64) + _U(1)) * _U(_GOLD))


_VALUES = _byte_values()
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` of them at least."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


class Words:
    """hashes: of all words in order; counts: words of each text; begin: the first word of each text, and the end."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        first, last = edge[0::2], edge[1::2]
        power, inverse = _power(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
        self._sums, self._inverse = sums, inverse
        self.hashes = self.pieces(first, last)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.begin = np.concatenate(([0], np.searchsorted(first, ends)))
        self.counts = np.diff(self.begin)
        self.first, self.last, self.data = first, last, data

    def pieces(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes; a word's is that of the same bytes anywhere."""
        return mix((self._sums[last] - self._sums[first]) * self._inverse[first] + (last - first).astype(np.uint64) * _U(_GOLD))


def groups(texts, most: int = 1 << 20):
    """(place of the first, encoded texts) in groups of about ``most`` bytes; null is empty."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        held.append((t.as_py() or "").encode())
        size += len(held[-1]) + 1
        if size >= most:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Each text's set of distinct ``k``-word shingles, sorted; fewer words make one shingle, no word makes none."""
    h, odd = words.hashes, [_U((_GOLD * (2 * j + 3)) % (1 << 64) | 1) for j in range(k)]
    n = max(0, len(h) - k + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(k):
        whole += mix(h[j : j + n] + _U(j)) * odd[j]
    whole = mix(whole)
    out = []
    for a, count in zip(words.begin[:-1], words.counts, strict=True):
        if count >= k:
            s = np.sort(whole[a : a + count - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif count:
            part = np.array([int(count) * _GOLD % (1 << 64)], np.uint64)
            for j in range(count):
                part = part + mix(h[a + j : a + j + 1] + _U(j)) * odd[j]
            out.append(mix(part))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
