"""Texts as arrays of folded code points: one table lookup folds case, width and form and drops what doesn't count."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_PLANES = 0x20000  # above are ideographs only, which fold to themselves
_CODES = 0x110000
#: Code points folded at a time; the arrays of a block take some 40 bytes each.
BLOCK = 1_000_000


def _table(fold) -> np.ndarray:
    table = np.zeros(_CODES, dtype=np.uint32)
    for c in range(_PLANES):
        table[c] = fold(chr(c))
    table[_PLANES:0x32400] = np.arange(_PLANES, 0x32400, dtype=np.uint32)
    return table


@lru_cache(1)
def alnum_table() -> np.ndarray:
    """Letters and digits in compatibility form and lower case; 0 for all else."""

    def fold(c: str) -> int:
        for x in unicodedata.normalize("NFKC", c).lower():
            if x.isalnum():
                return ord(x)
        return 0

    return _table(fold)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Letters (category L) in lower case and common width; 0 for all else."""

    def fold(c: str) -> int:
        wide = unicodedata.decomposition(c).split()
        if wide[:1] in (["<wide>"], ["<narrow>"]) and len(wide) == 2:
            c = chr(int(wide[1], 16))
        if unicodedata.category(c)[0] != "L":
            return 0
        low = c.lower()
        return ord(low if len(low) == 1 else c)

    return _table(fold)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts (null as '') in runs of at most BLOCK code points, or of one longer text, with the run's first index."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > BLOCK:
            yield first, run
            first, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run


_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(_MIX[2])
    return h ^ (h >> np.uint64(32))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit value for each run of k codes (k a power of two): doubled, as a suffix array is, from runs half as long."""
    with np.errstate(over="ignore"):
        h = mixed(codes.astype(np.uint64) + np.uint64(1))
        step = 1
        while step < k:
            if len(h) <= step:
                return h[:0]
            h = mixed(h[:-step] * np.uint64(_MIX[0]) + h[step:] * np.uint64(_MIX[1]))
            step *= 2
    return h
