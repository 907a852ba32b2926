"""Texts in folded case, as bytes, with the way back to their own bytes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Folded:
    """Texts in folded case, each followed by a line feed.

    data: their bytes; begin: where each text begins, and the end; upper: whether a character that was a capital
    begins at a byte; back: for each byte the place, in its own text, of the byte that it comes from.
    """

    data: np.ndarray
    begin: np.ndarray
    upper: np.ndarray
    back: np.ndarray


@cache
def _capital(char: int) -> bool:
    return chr(char).isupper() or chr(char).istitle()


def _widths(chars: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _fold(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray] | None:
    """(folded bytes, places of capitals, way back) of a text with other than ASCII letters; None if only ASCII changes."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:  # no text; its ASCII letters are folded
        return None
    low = text.casefold()
    old, parts = _points(text), None
    if len(low) == len(text):  # a character becomes one character at least, so each became one
        new, size = _points(low), _widths(_points(low))
    else:
        parts = [c.casefold() for c in text]
        size = np.array([len(x.encode()) for x in parts], np.int64)
        new = np.array([ord(x) if len(x) == 1 else 0 for x in parts], np.uint32)
    at, was = np.cumsum(size) - size, np.cumsum(_widths(old)) - _widths(old)
    changed = np.flatnonzero(old != new)
    kinds, which = np.unique(old[changed], return_inverse=True)
    capital = changed[np.array([_capital(int(k)) for k in kinds], bool)[which]] if len(kinds) else changed
    return low.encode(), at[capital], np.repeat(was, size) + np.arange(size.sum()) - np.repeat(at, size)


def fold(texts: list[bytes]) -> Folded:
    """Full case folding, so texts that differ in case only have the same bytes, in any script."""
    own = [None if x.isascii() else _fold(x) for x in texts]
    raw = [x if f is None else f[0] for x, f in zip(texts, own, strict=True)]
    begin = np.cumsum([0] + [len(x) + 1 for x in raw])
    given = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    data = _LOWER[given]
    upper = given != data
    back = np.arange(len(data)) - np.repeat(begin[:-1], np.diff(begin))
    for k, f in enumerate(own):
        if f is not None:
            upper[begin[k] + f[1]] = True
            back[begin[k] : begin[k + 1] - 1] = f[2]
            back[begin[k + 1] - 1] = len(texts[k])
    return Folded(data, begin, upper, back)
