"""Suffix arrays by induced sorting, on NumPy arrays, and permuted longest common prefixes.

The induced passes walk the buckets of the byte alphabet; inside a bucket they go in waves,
each wave being the suffixes placed by the one before, so that a pass is a few hundred
array operations. The reduced string of leftmost-smaller substrings has a large alphabet,
for which such waves don't pay; it is sorted by prefix doubling.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, the sentinel, is."""
    n = len(s)
    smaller = np.ones(n, bool)
    if n > 1:
        differs = s[:-1] != s[1:]
        at = np.where(differs, np.arange(n - 1), n)
        nxt = np.minimum.accumulate(at[::-1])[::-1]  # the end of a run of equal letters decides
        rises = np.ones(n + 1, bool)
        rises[: n - 1] = s[:-1] < s[1:]
        smaller[:-1] = rises[np.minimum(nxt, n)]
    return smaller


def _split(values: np.ndarray, letters: np.ndarray, into: list) -> None:
    """Append ``values``, in order, to the list of their letter."""
    if not len(values):
        return
    order = np.argsort(letters, kind="stable")
    letters = letters[order]
    cut = np.flatnonzero(np.diff(letters)) + 1
    for c, part in zip(letters[np.concatenate([[0], cut])].tolist(), np.split(values[order], cut), strict=True):
        into[c].append(part)


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix order that follows from the order ``seeds`` of the leftmost-smaller suffixes."""
    planted: list[list] = [[] for _ in range(alphabet)]
    _split(seeds, s[seeds], planted)
    empty = np.zeros(0, np.int64)
    larger: list = [empty] * alphabet
    heads: list[list] = [[] for _ in range(alphabet)]

    def before(wave, want):
        p = wave[wave > 0] - 1
        return p[smaller[p] == want]

    for c in range(alphabet):
        done = []
        wave = np.concatenate(heads[c]) if heads[c] else empty
        while len(wave):
            done.append(wave)
            p = before(wave, False)
            same = s[p] == c
            _split(p[~same], s[p[~same]], heads)
            wave = p[same]
        larger[c] = np.concatenate(done) if done else empty
        if planted[c]:
            p = before(np.concatenate(planted[c]), False)
            _split(p, s[p], heads)
    tails: list[list] = [[] for _ in range(alphabet)]
    out: list = []
    for c in range(alphabet - 1, -1, -1):
        done = []
        wave = np.concatenate(tails[c]) if tails[c] else empty
        if c == s[-1] and not len(wave):
            wave = np.array([len(s) - 1])
        while len(wave):
            done.append(wave)
            p = before(wave, True)
            same = s[p] == c
            _split(p[~same], s[p[~same]], tails)
            wave = p[same]
        p = before(larger[c][::-1], True)
        _split(p, s[p], tails)
        out.append(np.concatenate([*done, larger[c][::-1]]))
    return np.concatenate(out)[::-1]


def doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array of any integer string by prefix doubling."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        both = rank * (n + 2) + second
        order = np.argsort(both, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(both[order[1:]] != both[order[:-1]])
        rank = new
        if n < 2 or rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


def suffix_array(data: bytes) -> np.ndarray:
    """Suffix array of ``data`` followed by a sentinel below every byte; the sentinel's entry is left out."""
    s = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1, [0]])
    smaller = classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        order = induce(s, smaller, lms, 257)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        ordered = order[is_lms[order]]
        names = np.zeros(len(s), np.int64)
        names[ordered] = np.concatenate([[0], np.cumsum(~_same_substrings(s, smaller, lms, ordered))])
        reduced = names[lms]
        ranked = np.argsort(reduced, kind="stable") if reduced.max() == len(lms) - 1 else doubling(reduced)
        lms = lms[ranked]
    return induce(s, smaller, lms, 257)[1:]


def _same_substrings(s, smaller, lms, ordered) -> np.ndarray:
    """Whether each leftmost-smaller substring, in induced order, equals the one before it."""
    size = np.zeros(len(s), np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        equal = (s[x] == s[y]) & (smaller[x] == smaller[y])
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[size[a[live]] > k]
    return same


def permuted_lcp(data: bytes, sa: np.ndarray) -> np.ndarray:
    """By position: the common prefix length of its suffix and the one before it in order.

    Only positions whose left letters differ from their predecessor's are compared; along
    the rest the length falls by one a step.
    """
    n = len(sa)
    if not n:
        return np.zeros(0, np.int64)
    s = np.frombuffer(data, np.uint8)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = (i == 0) | (phi <= 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = s[rest - 1] != s[phi[rest] - 1]
    start = np.flatnonzero(fresh)
    length = np.zeros(n, np.int64)
    live = start[phi[start] >= 0]
    k = 0
    while len(live):
        x, y = live + k, phi[live] + k
        ok = (x < n) & (y < n)
        live, x, y = live[ok], x[ok], y[ok]
        live = live[s[x] == s[y]]
        length[live] += 1
        k += 1
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.where(fresh, length, np.maximum(length[last] - (i - last), 0))
