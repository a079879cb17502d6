"""Suffix arrays by induced sorting, and permuted common prefixes.

On bytes the scans run bucket by bucket on numpy arrays: everything in a bucket
that is known when the scan reaches it induces its predecessors at once. A
string of names has nearly as many buckets as symbols, so there the scans step
from suffix to suffix.
"""

from __future__ import annotations

from array import array

import numpy as np


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the end is smallest of all)."""
    n = len(t)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.where(t[:-1] < t[1:], 1, np.where(t[:-1] > t[1:], -1, 0))
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n), n)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    return sign[decided] > 0


def _induce_bytes(t, small, lms, sizes):
    """All suffixes in order, from leftmost-smaller ones that stand in order within each bucket."""
    n, sigma = len(t), len(sizes)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.empty(n, np.int32 if n < 1 << 30 else np.int64)
    first = t[lms]
    lms = lms[np.argsort(first, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=sigma))])
    at = heads.copy()

    def push(j, back):
        p = j[j > 0] - 1
        p = p[small[p] == back]
        if not len(p):
            return
        c = t[p]
        if len(p) <= 8:
            for x, y in zip(p.tolist(), c.tolist()):
                if back:
                    at[y] -= 1
                    sa[at[y]] = x
                else:
                    sa[at[y]] = x
                    at[y] += 1
            return
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(c)]]))
        rank = np.arange(len(c)) - np.repeat(starts, lengths)
        if back:
            sa[at[c] - 1 - rank] = p
            at[c[starts]] -= lengths
        else:
            sa[at[c] + rank] = p
            at[c[starts]] += lengths

    last = t[n - 1]
    sa[at[last]] = n - 1
    at[last] += 1
    full = np.flatnonzero(sizes)
    for c in full.tolist():
        lo = heads[c]
        while lo < at[c]:
            hi = at[c]
            push(sa[lo:hi].copy(), False)
            lo = hi
        if bounds[c] < bounds[c + 1]:
            push(lms[bounds[c]:bounds[c + 1]], False)
    large_end = at
    at = ends.copy()
    for c in full[::-1].tolist():
        hi = ends[c]
        while hi > at[c]:
            lo = at[c]
            push(sa[lo:hi][::-1].copy(), True)
            hi = lo
        if heads[c] < large_end[c]:
            push(sa[heads[c]:large_end[c]][::-1], True)
    return sa


def _induce_names(t, small, lms, sizes):
    """As ``_induce_bytes``, a suffix a step, for strings with many symbols."""
    n = len(t)
    ends = np.cumsum(sizes)
    # the symbol that a suffix induces, by its place: none before the first one, nor for an empty slot (-1)
    larger, smaller = np.full(n + 1, -1, "q"), np.full(n + 1, -1, "q")
    larger[1:n] = np.where(small[:-1], -1, t[:-1])
    smaller[1:n] = np.where(small[:-1], t[:-1], -1)
    larger, smaller = array("q", larger.tobytes()), array("q", smaller.tobytes())
    first = t[lms]
    order = np.argsort(first, kind="stable")
    count = np.bincount(first, minlength=len(sizes))
    slot = np.full(n, -1, "q")
    slot[np.repeat(ends - count, count) + np.arange(len(lms)) - np.repeat(np.cumsum(count) - count, count)] = lms[order]
    sa, at = array("q", slot.tobytes()), array("q", (ends - sizes).tobytes())
    last = int(t[n - 1])
    sa[at[last]] = n - 1
    at[last] += 1
    for j in sa:  # what is written ahead is met later
        c = larger[j]
        if c >= 0:
            k = at[c]
            sa[k] = j - 1
            at[c] = k + 1
    at = array("q", (ends - 1).tobytes())
    for j in reversed(sa):
        c = smaller[j]
        if c >= 0:
            k = at[c]
            sa[k] = j - 1
            at[c] = k - 1
    return np.frombuffer(sa, "q")


def _induce(t, small, lms, sizes):
    return (_induce_bytes if len(sizes) <= 256 else _induce_names)(t, small, lms, sizes)


def _name_substrings(t, lms, sigma):
    """Names, in order and equal for equal ones, of the leftmost-smaller substrings; each reaches to the first symbol of the next.

    They are sorted by as many symbols as fit a word at a time. One that is the
    beginning of another comes after it, as there the other falls on; only the
    last one, which meets the string's end, comes before.
    """
    m, n = len(lms), len(t)
    bits = (sigma + 1).bit_length()
    step = 63 // bits
    length = np.append(np.diff(lms) + 1, n - lms[-1])
    rank, live, k = np.zeros(m, np.int64), np.arange(m), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for d in range(k, k + step):
            within = d < length[live]
            symbol = t[np.minimum(lms[live] + d, n - 1)].astype(np.int64) + 1
            key = key << bits | np.where(within, symbol, np.where(live == m - 1, 0, sigma + 1))
        order = np.lexsort((key, rank[live])) if k else np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        of = rank[live]
        fresh = np.concatenate([[True], of[1:] != of[:-1]])
        new = fresh | np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(live))
        start = np.maximum.accumulate(np.where(new, place, 0))
        rank[live] = of + start - np.maximum.accumulate(np.where(fresh, place, 0))
        k += step
        live = live[~(new & np.concatenate([new[1:], [True]])) & (length[live] >= k)]
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of the suffixes of ``t`` (symbols below ``sigma``) in order."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    small = suffix_types(t)
    sizes = np.bincount(t, minlength=sigma)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        reduced = _name_substrings(t, lms, sigma)
        count = int(reduced.max()) + 1
        if count == len(lms):
            order = np.empty(count, np.int64)
            order[reduced] = np.arange(count)
        else:
            order = suffix_array(reduced, count)
        lms = lms[order]
    return _induce(t, small, lms, sizes)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the suffix before it in order (bytes).

    Only where the bytes before the two differ is a prefix compared; everywhere
    else it is one less than at the position before.
    """
    n = len(t)
    kind = np.int32 if n < 1 << 30 else np.int64
    before = np.concatenate([[0], t[:-1]]).astype(np.uint8)[sa]  # the byte before each suffix, in order
    differs = np.ones(n, bool)
    differs[1:] = before[1:] != before[:-1]
    differs |= sa == 0
    differs[1:] |= sa[:-1] == 0
    compare = np.empty(n, bool)
    compare[sa] = differs
    phi = np.empty(n, kind)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    compare[0] = True
    i = np.flatnonzero(compare)
    j = phi[i].astype(np.int64)
    i, j = i[j >= 0], j[j >= 0]
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.data, 0, (1,))
    length = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + length[live], j[live] + length[live]
        room = n - np.maximum(a, b)
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        length[live] += np.minimum(equal, room)
        live = live[(equal == 8) & (room > 8)]
    # prefix plus position is the same for all positions that follow from one comparison
    place = np.arange(n, dtype=kind)
    total = np.zeros(n, kind)
    total[compare] = place[compare]
    total[i] += length.astype(kind)
    start = np.flatnonzero(compare)
    return np.maximum(np.repeat(total[start], np.diff(np.concatenate([start, [n]]))) - place, 0)
