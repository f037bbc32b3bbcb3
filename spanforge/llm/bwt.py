"""Threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sort key: 9 bits each.
FIRST = 7


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Start places of s ordered by their first `depth` symbols at least (0 to 256; past the end counts as -1).

    Places already told apart by fewer symbols aren't sorted again."""
    n = len(s)
    padded = np.zeros(n + FIRST, np.uint64)
    padded[:n] = s.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(FIRST):
        key = key << np.uint64(9) | padded[k : k + n]
    order = np.argsort(key)  # the order of equal ones doesn't matter: intervals only count
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    sizes = np.diff(np.append(at, n))
    open_ = np.repeat(sizes > 1, sizes)
    h = FIRST
    while h < depth and open_.any():
        slots = np.flatnonzero(open_)
        own = order[slots]
        after = own + h
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[own].astype(np.uint64) << np.uint64(32) | nxt.astype(np.uint64)
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[slots] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(own)))
        rank[own] = np.repeat(slots[at], sizes)
        open_ = np.zeros(n, bool)
        open_[slots] = np.repeat(sizes > 1, sizes)
        h *= 2
    return order


def long_prefixes(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffix order of s, and for each place i of it but the first whether the suffixes at i - 1 and
    i have at least `least` symbols in common. Symbol 0 ends a string: intervals aren't extended over it, so what is
    said of suffixes with a 0 in their first `least` symbols doesn't count.

    Common prefixes come by increasing length: an interval of suffixes that begin with w is extended backwards by each
    symbol before them; where the interval of cw ends, the common prefix has the length of w, if it isn't known to be
    shorter. Only intervals that made an end known are extended on, and lengths stop before `least`.
    """
    n = len(s)
    order = suffix_order(s, least)
    last = s[order - 1].astype(np.int64)  # the transform; before the first place stands the last, a 0
    by = np.argsort(last.astype(np.uint16), kind="stable")
    to = np.empty(n, np.int64)
    to[by] = np.arange(n)
    same = last[by][1:] == last[by][:-1]
    following, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by[:-1][same]] = by[1:][same]
    before[by[1:][same]] = by[:-1][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lows, highs = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for length in range(least):
        size = highs - lows
        x = np.repeat(lows - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        low, high = np.repeat(lows, size), np.repeat(highs, size)
        if length:
            live = last[x] != 0
            x, low, high = x[live], low[live], high[live]
        starts = np.sort(to[x[before[x] < low]])
        ends = np.sort(to[x[following[x] >= high]]) + 1
        new = ~known[ends]
        known[ends[new]] = True
        lows, highs = starts[new], ends[new]
        if not len(lows):
            break
    common = ~known[:n]
    return order, common


def repeated_starts(segments: list[bytes], least: int) -> list[np.ndarray]:
    """For each segment, the places at which a string of `least` bytes begins that begins at another place of these
    segments too."""
    sizes = np.array([len(x) for x in segments])
    s = np.zeros(sizes.sum() + len(segments), np.int16)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    flat = np.frombuffer(b"".join(segments), np.uint8)
    s[np.arange(len(flat)) + np.repeat(np.arange(len(segments)), sizes)] = flat.astype(np.int16) + 1
    order, common = long_prefixes(s, least)
    hit = common.copy()
    hit[:-1] |= common[1:]
    marked = np.zeros(len(s), bool)
    marked[order[hit]] = True
    return [np.flatnonzero(marked[a : a + max(0, n - least + 1)]) for a, n in zip(starts, sizes, strict=True)]
