"""Content-chosen anchors: each string of SPAN bytes of a text picks one of its own grams, by their hashes only.

Equal strings pick the same gram at the same place, wherever they stand, so strings can be compared among those
with equal grams. The strings that pick one anchor start at neighbouring places; together they are its region.
"""

from __future__ import annotations

import functools

import numpy as np

from lumenrel.llm import _common as c

SPAN = 50
GRAM = 24
WINDOW = SPAN - GRAM + 1
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def forget() -> None:
    """Give the tables of powers back; workers outlive their tasks."""
    _powers.cache_clear()


class Hashes:
    """64-bit hashes of any spans of flat bytes, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(1 << max(16, int(len(data)).bit_length()))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        terms = c._BYTE_KEYS[data]
        terms *= up[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return c.mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        out = self.sums[n:] - self.sums[:m]
        out *= self.down[:m]
        return out


def anchors(data: np.ndarray, offsets: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its place, the first and last start of the strings that pick it (ascending), and its gram's hash."""
    none = np.zeros(0, np.int64)
    m = len(data) - SPAN + 1
    if m <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    bits = np.uint64(int(len(data)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    g = hashes.grams(GRAM)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    g &= ~low
    g |= np.arange(len(g), dtype=np.uint64)  # the first of equals is least
    size, least = 1, g
    while size * 2 <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - size)], least[WINDOW - size :])
    del g
    least &= low
    picked = least[:m].astype(np.int64)
    del least
    inside = np.ones(m + 1, bool)
    inside[m] = False
    for e in offsets[1:-1].tolist():  # strings that would cross into the next text
        inside[max(0, e - SPAN + 1) : min(e, m)] = False
    edge = np.empty(m, bool)
    edge[0] = True
    np.not_equal(picked[1:], picked[:-1], out=edge[1:])
    edge[1:] |= inside[:-2] != inside[1:-1]
    first = np.flatnonzero(edge)
    last = np.append(first[1:], m) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    at = picked[first]
    return at, first, last, hashes.of(at, at + GRAM)
