"""Words of many texts at once, hashed in NumPy.

A word is a run of ASCII letters and digits and of bytes beyond ASCII, after
lower-casing; all else separates.  The hash of a word is a polynomial over its bytes,
taken from prefix sums and moved to the word's own origin, then mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
INSIDE = np.array([bytes([b]).isalnum() or b >= 0x80 for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_UP, _DOWN = powers(BASE, 1 << 10), powers(INVERSE, 1 << 10)


def _grow(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) <= n:
        _UP, _DOWN = powers(BASE, 2 * n), powers(INVERSE, 2 * n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after) of each word of ``raw``, which is lower-cased UTF-8."""
    found = []
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            cut = BREAK.search(raw, end)
            end = cut.start() if cut else len(raw)
        part = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        _grow(len(part))
        edge = np.flatnonzero(np.diff(INSIDE[part], prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        total = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)])])
        found.append((mix((total[stop] - total[start]) * _DOWN[start]), start + at, stop + at))
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def batched(texts: list[str | None], most: int = PIECE) -> Iterator[tuple]:
    """Words of texts, small ones together: (first text, text after, bytes, hash, start, stop, words before each text, first byte of each text).

    The last two arrays have one entry more than texts, so text k of the run has words
    cuts[k] to cuts[k + 1] and bytes first[k] to first[k + 1] - 1.
    """
    at = 0
    while at < len(texts):
        parts, size, k = [], 0, at
        while k < len(texts) and (k == at or size < most):
            parts.append((texts[k] or "").lower().encode())
            size += len(parts[-1]) + 1
            k += 1
        raw = b"\n".join(parts)
        first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        value, start, stop = hashed_words(raw)
        yield at, k, raw, value, start, stop, np.searchsorted(start, first), first
        at = k


def shingles(value: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` words in a row, in order."""
    m = len(value) - n + 1
    if m <= 0:
        return value[:0]
    total = np.zeros(m, np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
        total += value[k : k + m] * np.uint64(factor)
    return mix(total)
