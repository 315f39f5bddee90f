"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes as larger or smaller than the next one,
sorts the leftmost-smaller (LMS) substrings by inducing, names them, sorts the
string of names recursively where names repeat, and induces all suffixes from
the sorted LMS ones in two linear scans. For bytes the scans run bucket by
bucket as array operations; the recursion, whose alphabet is large and whose
string is at most half as long, scans entry by entry. Blocks are ordered by
character with a radix sort, numpy's stable sort of 16-bit keys, so all is linear
in the string; common prefixes are asked for up to a constant length.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller (S); the last, a unique smallest sentinel, is S."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # i with t[i] != t[i+1]
    up = t[change] < t[change + 1]
    s = np.ones(n, bool)
    at = np.searchsorted(change, np.arange(n - 1))  # the change that decides i
    s[:-1] = up[np.minimum(at, len(change) - 1)] if len(change) else False
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: list[int]) -> np.ndarray:
    """All suffixes from LMS positions in order. Scans buckets up for the larger type, down for the smaller."""
    n = len(t)
    t = t.astype(np.uint16)
    sa = np.full(n, -1, np.int64)
    count = np.bincount(t[lms], minlength=len(starts))
    first = ends - count
    # LMS suffixes at the ends of their buckets, in the given order.
    order = np.argsort(t[lms], kind="stable")
    sorted_lms = lms[order]
    c = t[sorted_lms]
    within = np.arange(len(lms)) - (np.cumsum(count) - count)[c]
    sa[first[c] + within] = sorted_lms
    head = starts.copy()

    def place_up(block: np.ndarray) -> None:
        j = block - 1
        j = j[j >= 0]
        j = j[~s[j]]
        if len(j):
            ch = t[j]
            o = np.argsort(ch, kind="stable")
            j, ch = j[o], ch[o]
            got = np.bincount(ch, minlength=len(head))
            sa[head[ch] + np.arange(len(j)) - (np.cumsum(got) - got)[ch]] = j
            head[:] += got

    for ch in chars:
        done = int(starts[ch])
        while done < head[ch]:
            upto = int(head[ch])
            place_up(sa[done:upto].copy())
            done = upto
        if count[ch]:
            place_up(sa[first[ch] : ends[ch]].copy())
    larger_end = head.copy()
    tail = ends.copy()

    def place_down(block: np.ndarray) -> None:
        j = block[::-1] - 1
        j = j[j >= 0]
        j = j[s[j]]
        if len(j):
            ch = t[j]
            o = np.argsort(ch, kind="stable")
            j, ch = j[o], ch[o]
            got = np.bincount(ch, minlength=len(tail))
            sa[tail[ch] - 1 - (np.arange(len(j)) - (np.cumsum(got) - got)[ch])] = j
            tail[:] -= got

    for ch in reversed(chars):
        done = int(ends[ch])
        while done > tail[ch]:
            upto = int(tail[ch])
            place_down(sa[upto:done].copy())
            done = upto
        if larger_end[ch] > starts[ch]:
            place_down(sa[starts[ch] : larger_end[ch]].copy())
    sa[0] = n - 1
    return sa


def _equal_lms(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the LMS substrings at a and b, of the given lengths at a and b, are equal."""
    la, lb = length
    same = la == lb
    at, k = np.flatnonzero(same), 0
    while len(at):
        eq = t[a[at] + k] == t[b[at] + k]
        same[at[~eq]] = False
        k += 1
        at = at[eq]
        at = at[la[at] > k]
    return same


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers that end with a unique 0."""
    n = len(t)
    if n < 3:
        return np.arange(n - 1, -1, -1)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    starts = ends - counts
    chars = np.flatnonzero(counts).tolist()
    sa = _induce(t, s, lms, starts, ends, chars)
    if len(lms) < 2:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by = sa[is_lms[sa]]  # LMS positions by LMS substring
    size = np.zeros(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    differ = np.ones(len(by), np.int64)
    differ[1:] = ~_equal_lms(t, by[:-1], by[1:], (size[by[:-1]], size[by[1:]]))
    name = np.zeros(n, np.int64)
    name[by] = np.cumsum(differ) - 1
    names = name[lms]
    if int(names.max()) + 1 < len(lms):
        order = np.array(_recurse(names.tolist(), int(names.max()) + 1), np.int64)
    else:
        order = np.empty(len(lms), np.int64)
        order[names] = np.arange(len(lms))
    return _induce(t, s, lms[order], starts, ends, chars)


def _recurse(t: list[int], k: int) -> list[int]:
    """The same over a string of names (alphabet 0..k-1, last a unique smallest), entry by entry."""
    n = len(t)
    if n == 1:
        return [0]
    s = bytearray(n)
    s[n - 1] = 1
    for i in range(n - 2, -1, -1):
        s[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and s[i + 1])
    counts = [0] * k
    for c in t:
        counts[c] += 1
    starts, total = [0] * (k + 1), 0
    for c in range(k):
        starts[c] = total
        total += counts[c]
    starts[k] = total
    lms = [i for i in range(1, n) if s[i] and not s[i - 1]]

    def induce(given: list[int]) -> list[int]:
        sa = [-1] * n
        tail = starts[1:]
        for i in reversed(given):
            tail[t[i]] -= 1
            sa[tail[t[i]]] = i
        head = starts[:k]
        for i in range(n):
            j = sa[i] - 1
            if j >= 0 and not s[j]:
                c = t[j]
                sa[head[c]] = j
                head[c] += 1
        tail = starts[1:]
        for i in range(n - 1, -1, -1):
            j = sa[i] - 1
            if j >= 0 and s[j]:
                c = t[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    sa = induce(lms)
    if len(lms) < 2:
        return sa
    end = {a: b for a, b in zip(lms, lms[1:])}
    name, last, now = {}, None, -1
    for i in sa:
        if i > 0 and s[i] and not s[i - 1]:
            sub = t[i : end.get(i, i) + 1]
            if sub != last:
                now, last = now + 1, sub
            name[i] = now
    reduced = [name[i] for i in lms]
    if now + 1 < len(lms):
        order = _recurse(reduced, now + 1)
    else:
        order = [0] * len(lms)
        for i, c in enumerate(reduced):
            order[c] = i
    return induce([lms[i] for i in order])


def permuted_lcp(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """PLCP: for each text position, the common prefix with the suffix before it in the array, at most ``cap``.

    Bytes are compared eight at a time; the unique sentinel ends every comparison.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int32)
    at = np.flatnonzero(before >= 0)
    if t.max(initial=0) < 256:
        padded = np.zeros(n + cap + 16, np.uint8)
        padded[:n] = t
        words = np.ndarray((n + cap + 8,), "<u8", padded, 0, (1,))
        for k in range(0, cap, 8):
            x = words[at + k] ^ words[before[at] + k]
            differ = x != 0
            x = x[differ]
            plcp[at[differ]] = np.minimum(cap, k + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
            at = at[~differ]
            if not len(at):
                break
        plcp[at] = cap
        return plcp
    for k in range(cap):
        at = at[np.maximum(at, before[at]) + k < n]
        at = at[t[at + k] == t[before[at] + k]]
        if not len(at):
            break
        plcp[at] = k + 1
    return plcp
