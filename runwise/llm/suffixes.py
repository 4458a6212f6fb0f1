"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The start of each suffix of ``s`` (numbers from 0), in order; a suffix precedes those that it begins.

    Suffixes are classed as smaller or larger than the next one. The leftmost smaller ones are the
    starts of the substrings that are sorted by one round of induction, named, and sorted for good
    by the same method on the string of names; from them the order of all others is induced in two
    linear scans. A scan goes through the buckets of first letters and handles the entries of a
    bucket together, those that it adds to the bucket itself in further turns.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = np.asarray(s, np.int64)
    k = int(s.max()) + 1
    smaller = _smaller(s)
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(starts) < 2:
        return _induce(s, k, smaller, starts)
    order = _induce(s, k, smaller, starts)
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    order = order[is_start[order]]
    names = _names(s, starts, order)
    if names.max() + 1 < len(starts):
        sorted_starts = starts[_sorted_names(names)]
    else:
        sorted_starts = order
    return _induce(s, k, smaller, sorted_starts)


#: Letters from which buckets hold too few entries to be handled one after the other.
FEW_LETTERS = 2048


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """The suffix array of the string of names.

    Names are mostly different, so that buckets hold an entry or two. The recursion is then a
    refinement: suffixes are sorted by twice as many names in each round, where they still tie.
    """
    if names.max() < FEW_LETTERS:
        return suffix_array(names)
    n, rank, step = len(names), names.copy(), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:-step] = rank[step:]
        key = rank * np.int64(n + 2) + after + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step
        if step >= n:
            return np.argsort(rank, kind="stable")


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is larger than the empty one."""
    differ = np.flatnonzero(s[:-1] != s[1:])
    out = np.zeros(len(s), bool)
    if len(differ):
        at = np.searchsorted(differ, np.arange(differ[-1] + 1))
        d = differ[at]
        out[: len(d)] = s[d] < s[d + 1]
    return out


def _names(s: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for the substring from each start to the next one, in text order; equal ones share it."""
    n = len(s)
    place = np.empty(n, np.int64)
    place[starts] = np.arange(len(starts))
    ends = np.append(starts[1:], n)  # the next start belongs to the substring
    idx = place[order]
    a, length = order, ends[idx] - order
    same = np.zeros(len(order), bool)
    pairs = np.flatnonzero((length[1:] == length[:-1]) & (ends[idx][1:] < n) & (ends[idx][:-1] < n)) + 1
    step = 0
    alive, x, y, l = pairs, a[pairs], a[pairs - 1], length[pairs]
    while len(alive):
        equal = s[x + step] == s[y + step]
        done = equal & (l == step)
        same[alive[done]] = True
        go = equal & ~done
        alive, x, y, l = alive[go], x[go], y[go], l[go]
        step += 1
    names = np.empty(len(starts), np.int64)
    names[idx] = np.cumsum(~same) - 1
    return names


def _induce(s: np.ndarray, k: int, smaller: np.ndarray, sorted_starts: np.ndarray) -> np.ndarray:
    n = len(s)
    count = np.bincount(s, minlength=k)
    end = np.cumsum(count)
    begin = end - count
    large = np.bincount(s[~smaller], minlength=k)
    sa = np.full(n, -1, np.int64)
    by_bucket = sorted_starts[np.argsort(s[sorted_starts], kind="stable")]
    per = np.bincount(s[by_bucket], minlength=k)
    first = np.cumsum(per) - per

    def place(entries, at, up):
        """Put entries, in order, at the free ends of their buckets."""
        c = s[entries]
        order = np.argsort(c, kind="stable")
        entries, c = entries[order], c[order]
        run = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(run, len(c)))
        within = np.arange(len(c)) - np.repeat(run, size)
        if up:
            sa[at[c] + within] = entries
            at[c[run]] += size
        else:
            sa[at[c] - within] = entries
            at[c[run]] -= size

    at = begin.copy()
    place(np.array([n - 1]), at, True)  # the last suffix stands behind the empty one
    for c in range(k):
        if not count[c]:
            continue
        low, turn = begin[c], True
        while turn:
            high = at[c]
            entries = sa[low:high]
            low = high
            turn = len(entries) > 0
            if turn:
                p = entries[entries > 0] - 1
                p = p[~smaller[p]]
                if len(p):
                    place(p, at, True)
        p = by_bucket[first[c] : first[c] + per[c]]
        p = p[p > 0] - 1
        p = p[~smaller[p]]
        if len(p):
            place(p, at, True)
    at = end - 1
    for c in range(k - 1, -1, -1):
        if not count[c]:
            continue
        high, turn = end[c], True
        while turn:  # smaller suffixes of this bucket, from the end
            low = at[c] + 1
            entries = sa[low:high][::-1]
            high = low
            turn = len(entries) > 0
            if turn:
                p = entries[entries > 0] - 1
                p = p[smaller[p]]
                if len(p):
                    place(p, at, False)
        entries = sa[begin[c] : begin[c] + large[c]][::-1]
        p = entries[entries > 0] - 1
        p = p[smaller[p]]
        if len(p):
            place(p, at, False)
    return sa


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By position: how long a prefix its suffix shares with the suffix before it in order, up to ``most``.

    The prefixes are permuted, that is in order of the text, where they fall by one at most from a
    place to the next. So a place that shares less than ``most`` with its predecessor is
    compared only at a few places: powers of two of hashes of the text give the length by bisection.
    """
    n = len(s)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    x = np.flatnonzero(before >= 0)
    y = before[x]
    levels = [_mixed(np.asarray(s, np.uint64))]
    while 2 << len(levels) - 1 <= most:
        h, d = levels[-1], 1 << len(levels) - 1
        if len(h) <= d:
            break
        levels.append(_mixed(h[:-d] * np.uint64(0x9E3779B97F4A7C15) + h[d:]))
    got = np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        d, h = 1 << j, levels[j]
        for _ in range(most >> j if j == len(levels) - 1 else 1):
            fits = (np.maximum(x, y) + got + d <= n) & (got + d <= most)
            i = np.flatnonzero(fits)
            i = i[h[x[i] + got[i]] == h[y[i] + got[i]]]
            if not len(i):
                break
            got[i] += d
    out[x] = got
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
