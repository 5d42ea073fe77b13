"""Vectorised hashing of texts: code points of many texts in one array, spans hashed by prefix sums modulo 2^64."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and the offsets of the texts with the total at the end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate(([0], np.cumsum(lengths)))


class SpanHash:
    """Hashes of spans [start, end) of a sequence of unsigned values; equal spans have equal hashes wherever they lie."""

    def __init__(self, values: np.ndarray, which: int = 0):
        base, n = _BASES[which], len(values)
        inverse = U(pow(int(base), -1, 1 << 64))
        self.seed = _SEEDS[which]
        grow = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, base, U))))
        self.shrink = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, inverse, U))))
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(values.astype(U) * U(0xC2B2AE3D27D4EB4F) + self.seed) * grow[:n])))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.shrink[start]
        return mix(h + (end - start).astype(U) * self.seed)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def by_size(rows: Iterator[tuple[object, str]], size: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) in groups of about ``size`` characters; a longer text is a group of its own."""
    keys, texts, total = [], [], 0
    for k, t in rows:
        if texts and total + len(t) > size:
            yield keys, texts
            keys, texts, total = [], [], 0
        keys.append(k)
        texts.append(t)
        total += len(t)
    if texts:
        yield keys, texts


_WORD_CHAR: np.ndarray | None = None


def word_char() -> np.ndarray:
    """For each code point whether it is a letter or digit (Unicode categories L and N)."""
    global _WORD_CHAR
    if _WORD_CHAR is None:
        _WORD_CHAR = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _WORD_CHAR


def words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, SpanHash]:
    """The texts in lower case; start, end and text number of each maximal run of letters and digits; a hash over the characters."""
    low = [t.lower() for t in texts]
    cp, off = code_points([t + "\n" for t in low])
    flag = np.concatenate(([False], word_char()[cp], [False]))
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    start, end = edge[::2], edge[1::2]
    return low, start, end, np.searchsorted(off, start, "right") - 1, SpanHash(cp)
