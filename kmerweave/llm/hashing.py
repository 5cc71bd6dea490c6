"""Hashes of words and of runs of words, many texts at a time.

A run's hash is a polynomial over its words' hashes modulo 2^64. With prefix sums every run costs one subtraction and
one multiplication, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are put together up to so many bytes; a longer text stands alone.
TOGETHER = 1 << 18


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of runs ``[start, end)`` of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = _powers_for(len(values) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[:len(values)])])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix(value + (end - start).astype(np.uint64))


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts put together, where each word starts and ends there, and each text's first word (one more entry: the
    number of words)."""
    whole = b"\n".join(texts) + b"\n"
    data = np.frombuffer(whole, np.uint8)
    space = _SPACE[data]
    inside = np.concatenate([[True], space])
    starts = np.flatnonzero(inside[:-1] & ~space)
    ends = np.flatnonzero(~inside[1:-1] & space[1:]) + 1
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return whole, starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Runs(_LETTERS[np.frombuffer(data, np.uint8)]).hash(starts, ends)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's first word's index (one more entry: the end)."""
    data, starts, ends, first = word_spans(texts)
    return span_hashes(data, starts, ends), first


def together(rows: Iterable[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups rows ``(key, text)`` so that each group's texts have about ``TOGETHER`` bytes."""
    keys, texts, size = [], [], 0
    for key, text in rows:
        keys.append(key)
        texts.append(text)
        size += len(text) + 1
        if size >= TOGETHER:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
