"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Over a small alphabet the scans of induced sorting are taken bucket by bucket: what a bucket's suffixes induce is dealt
out at once, and only runs of one symbol need another round within their bucket. Over a large one, as a reduced
string has, and in short strings they go suffix by suffix. Both take linear time.
"""

from __future__ import annotations

import numpy as np

#: Size of the alphabets that are scanned by bucket; strings up to so many symbols are scanned suffix by suffix.
BUCKETS, SHORT = 1 << 9, 1 << 11


def classify(text: np.ndarray) -> np.ndarray:
    """True for each suffix that is smaller than the next one (S-type); the last one is larger than the end."""
    n = len(text)
    differ = np.flatnonzero(text[:-1] != text[1:])
    out = np.zeros(n, bool)
    if len(differ):
        # A suffix takes the type of the next place where two neighbours differ.
        up = text[differ] < text[differ + 1]
        out[: differ[-1] + 1] = np.repeat(up, np.diff(differ, prepend=-1))
    return out


def _deal(places: np.ndarray, symbols: np.ndarray, piles: list[list[np.ndarray]]) -> None:
    """Append places to the piles of their symbols, in order."""
    if not len(places):
        return
    order = np.argsort(symbols, kind="stable")
    symbols, places = symbols[order], places[order]
    cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    begins = [0, *cut.tolist()]
    for s, a, b in zip(symbols[begins].tolist(), begins, [*begins[1:], len(places)], strict=True):
        piles[s].append(places[a:b])


def _spread(pile: list[np.ndarray], text: np.ndarray, small: np.ndarray, kind: bool, symbol: int, piles: list[list[np.ndarray]]) -> np.ndarray:
    """Scan a bucket's suffixes, rounds of runs included, and deal out the suffixes before them that have the kind."""
    done = []
    front = np.concatenate(pile) if pile else np.empty(0, np.int64)
    while len(front):
        done.append(front)
        before = front[front > 0] - 1
        before = before[small[before] == kind]
        symbols = text[before]
        own = symbols == symbol
        _deal(before[~own], symbols[~own], piles)
        front = before[own]
    return np.concatenate(done) if done else np.empty(0, np.int64)


def induce(text: np.ndarray, small: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the seeds (leftmost S-type suffixes, in order within each symbol) induce."""
    if len(text) <= SHORT or size > BUCKETS:
        return _one_by_one(text, small, size, seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    left: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(seeds, text[seeds], left)
    last = len(text) - 1
    large[int(text[last])].append(np.array([last]))
    sorted_large = []
    for c in range(size):
        sorted_large.append(_spread(large[c], text, small, False, c, large))
        if left[c]:
            before = np.concatenate(left[c])
            before = before[before > 0] - 1
            _deal(before, text[before], large)  # what stands before a leftmost one is L-type, of a larger symbol
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        own = _spread(smaller[c], text, small, True, c, smaller)
        tail = sorted_large[c][::-1]
        before = tail[tail > 0] - 1
        before = before[small[before]]
        _deal(before, text[before], smaller)
        out += [own, tail]
    return np.concatenate(out)[::-1]


def _one_by_one(text: np.ndarray, small: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    """induce() over an alphabet of any size."""
    ends, n = np.cumsum(np.bincount(text, minlength=size)), len(text)
    # Symbols of the suffixes that a scan places; -1 for the others, and for what stands before the first one.
    falls, rises = (np.append(np.where(kind, text, -1), -1).tolist() for kind in (~small, small))
    out, tail, head = [0] * n, ends.tolist(), [0, *ends[:-1].tolist()]
    for i, c in zip(seeds[::-1].tolist(), text[seeds[::-1]].tolist(), strict=True):
        tail[c] -= 1
        out[tail[c]] = i
    c = int(text[n - 1])
    out[head[c]] = n - 1
    head[c] += 1
    for i in out:  # sees what is placed ahead of it
        c = falls[i - 1]
        if c >= 0:
            at = head[c]
            out[at] = i - 1
            head[c] = at + 1
    tail = ends.tolist()
    for i in reversed(out):
        c = rises[i - 1]
        if c >= 0:
            at = tail[c] - 1
            out[at] = i - 1
            tail[c] = at
    return np.array(out, np.int64)


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of symbols below `size`; a suffix that ends is smaller than one that goes on."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = classify(text)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(left):
        return induce(text, small, size, left)
    # One round of inducing sorts the leftmost-smaller substrings; equal ones get one name.
    order = induce(text, small, size, left)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = order[is_left[order]]
    place = np.empty(n, np.int64)
    place[left] = np.arange(len(left))
    ends = np.append(left[1:], n - 1)
    length = np.append(np.diff(left), n - left[-1])  # the last one runs into the end and equals no other
    a, b = order[:-1], order[1:]
    same = length[place[a]] == length[place[b]]
    at = np.flatnonzero(same)
    k = 0
    while len(at):  # compare symbol by symbol what still agrees
        at_a, at_b = a[at] + k, b[at] + k
        inside = (at_a <= ends[place[a[at]]]) & (at_b <= ends[place[b[at]]])
        agree = np.ones(len(at), bool)
        agree[inside] = text[at_a[inside]] == text[at_b[inside]]
        same[at[~agree]] = False
        at = at[agree & inside]
        k += 1
    if len(order) > 1:
        last = place[order] == len(left) - 1
        same &= ~(last[:-1] | last[1:])
    name = np.concatenate([[0], np.cumsum(~same)])
    reduced = np.empty(len(left), np.int64)
    reduced[place[order]] = name
    if name[-1] + 1 < len(left):
        order = left[suffix_array(reduced, int(name[-1]) + 1)]
    return induce(text, small, size, order)


def common_prefixes(text: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """Permuted common prefixes: for each place, how much its suffix shares with the one before it in the array.

    A prefix ends before the symbol `stop`. Only irreducible values, where the symbols before the two suffixes differ,
    are measured; each other value is one less than that of the place before.
    """
    n = len(text)
    other = np.full(n, -1, np.int64)
    other[order[1:]] = order[:-1]
    here = np.arange(n)
    before, theirs = text[np.maximum(here - 1, 0)], text[np.maximum(other - 1, 0)]
    reducible = (here > 0) & (other > 0) & (before == theirs) & (before != stop)
    at = np.flatnonzero(~reducible)
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(other[at] >= 0)
    k = 0
    padded = np.append(text, stop)
    while len(live):
        x, y = padded[np.minimum(at[live] + k, n)], padded[np.minimum(other[at[live]] + k, n)]
        live = live[(x == y) & (x != stop)]
        value[live] += 1
        k += 1
    # A reducible place's value is the last irreducible one's, less the distance.
    source = np.cumsum(~reducible) - 1
    return value[source] - (here - at[source])
