"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are S-type (smaller than the next one) or L-type. The leftmost S-type ones (LMS) are
put in order by sorting the substrings between them, which is done by inducing from their
first letters; equal substrings get equal names, and the string of names is sorted in turn.
From the order of the LMS suffixes all others are induced, bucket by bucket: first the L-type
ones upwards, then the S-type ones downwards. Within a bucket whole arrays of suffixes are
moved at once.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are sorted by inducing, larger ones (strings of names) by doubling ranks.
MOST_BUCKETS = 512


def _types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are S-type; the end of the string is smaller than any letter."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    # the place of the next change at or after i; beyond the last one suffixes are L-type
    s = np.zeros(n, bool)
    if len(change):
        upto = np.arange(change[-1] + 1)
        place = change[np.searchsorted(change, upto)]
        s[upto] = t[place] < t[place + 1]
    return s


def _push(lists: list[list[np.ndarray]], t: np.ndarray, entries: np.ndarray, c: int, up: bool) -> None:
    """Put the predecessors whose letter is above (below) c at the end of their buckets, in order."""
    p = entries[entries > 0] - 1
    letters = t[p]
    fit = letters > c if up else letters < c
    p, letters = p[fit], letters[fit]
    if not len(p):
        return
    order = np.argsort(letters, kind="stable")
    p, letters = p[order], letters[order]
    cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for part, letter in zip(np.split(p, cuts), letters[np.concatenate([[0], cuts])].tolist(), strict=True):
        lists[letter].append(part)


def _bucket(lists: list[np.ndarray], t: np.ndarray, s: np.ndarray, c: int, s_type: bool) -> np.ndarray:
    """A bucket's entries of one type: those pushed so far, then in turn their predecessors with the same letter."""
    if not lists:
        return np.zeros(0, np.int64)
    out = [np.concatenate(lists) if len(lists) > 1 else lists[0]]
    while len(out[-1]):
        p = out[-1][out[-1] > 0] - 1
        out.append(p[(t[p] == c) & (s[p] == s_type)])
    return np.concatenate(out)


def _induce(t: np.ndarray, s: np.ndarray, lms: list[np.ndarray], k: int) -> np.ndarray:
    """All suffixes in order, from the LMS ones of each bucket in order."""
    n = len(t)
    pushed: list[list[np.ndarray]] = [[] for _ in range(k)]
    pushed[int(t[n - 1])].append(np.array([n - 1], np.int64))
    large: list[np.ndarray] = []
    for c in range(k):
        large.append(_bucket(pushed[c], t, s, c, False))
        _push(pushed, t, large[c], c, True)
        _push(pushed, t, lms[c], c, True)
    pushed = [[] for _ in range(k)]
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        small = _bucket(pushed[c], t, s, c, True)
        _push(pushed, t, small, c, False)
        _push(pushed, t, large[c][::-1], c, False)
        out += [small, large[c][::-1]]
    return np.concatenate(out)[::-1]


def _by_letter(t: np.ndarray, entries: np.ndarray, k: int) -> list[np.ndarray]:
    letters = t[entries]
    order = np.argsort(letters, kind="stable")
    cuts = np.searchsorted(letters[order], np.arange(1, k))
    return np.split(entries[order], cuts)


def _names(t: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings in the given order; equal ones get equal numbers."""
    ends = np.append(lms[1:], len(t) - 1)
    length = np.zeros(len(t), np.int64)
    length[lms] = ends - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    # the last one ends at the string's end, which no other does
    same &= (a != lms[-1]) & (b != lms[-1])
    live, d = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + d] == t[b[live] + d]
        same[live[~equal]] = False
        d += 1
        live = live[equal]
        live = live[length[a[live]] > d]
    return np.concatenate([[0], np.cumsum(~same)])


def _double(t: np.ndarray) -> np.ndarray:
    """Suffix array by doubling ranks; only suffixes that still tie are sorted again."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    head = np.concatenate([[True], t[order[1:]] != t[order[:-1]]])
    # a suffix's rank is the place of the first one it ties with
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 1
    while not head.all():
        tied = ~head
        tied[:-1] |= ~head[1:]
        place = np.flatnonzero(tied)
        suffix = order[place]
        first = rank[suffix]
        second = rank[np.minimum(suffix + h, n)]
        key = first * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[place] = suffix[by]
        key = key[by]
        head[place] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[place]] = np.maximum.accumulate(np.where(head[place], place, 0))
        h *= 2
    return order


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """Positions of all suffixes of t (letters 0 to k-1) in order."""
    n = len(t)
    k = int(t.max()) + 1 if k is None and n else k
    if n < 2:
        return np.arange(n)
    if k > MOST_BUCKETS:
        return _double(t)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(lms):
        return _induce(t, s, [np.zeros(0, np.int64)] * k, k)
    rough = _induce(t, s, _by_letter(t, lms, k), k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    names = _names(t, order, lms)
    if names[-1] + 1 < len(lms):
        place = np.empty(n, np.int64)
        place[order] = names
        order = lms[suffix_array(place[lms], int(names[-1]) + 1)]
    return _induce(t, s, _by_letter(t, order, k), k)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted: for each position, how much its suffix shares with the one before it in the suffix array.

    t holds bytes. Where the letters before the two suffixes are the same, the value is that of the position
    before less one; elsewhere they are compared, eight bytes at a time.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    i = np.arange(1, n)
    j = before[1:]
    fresh[1:] = ~((j > 0) & (before[:-1] >= 0) & (t[i - 1] == t[j - 1]))
    # the position before may have another neighbour, so the rule needs the neighbours to follow each other too
    fresh[1:] |= before[:-1] != j - 1
    words = np.zeros(n + 8, np.uint64)
    padded = np.concatenate([t.astype(np.uint64), np.zeros(16, np.uint64)])
    for b in range(8):
        words |= padded[b : b + n + 8] << np.uint64(8 * b)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & (before >= 0))
    a, b = live.copy(), before[live]
    while len(live):
        diff = words[a] ^ words[b]
        full = (diff == 0) & (np.maximum(a, b) + 8 <= n)
        low = diff & (~diff + np.uint64(1))
        # the lowest differing byte, or as far as the text goes
        bytes_same = np.where(diff == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 8).astype(np.int64))
        step = np.minimum(bytes_same, n - np.maximum(a, b))
        out[live] += np.where(full, 8, step)
        live, a, b = live[full], a[full] + 8, b[full] + 8
        more = np.maximum(a, b) < n
        live, a, b = live[more], a[more], b[more]
    source = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(out[source] - (np.arange(n) - source), 0)
