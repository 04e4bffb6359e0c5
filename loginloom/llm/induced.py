"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard's bytes."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (type S); the last is not."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        # an equal run takes the type of its end
        run = np.searchsorted(differs, np.arange(n - 1))
        ends = np.append(t[differs] < t[differs + 1], False)
        s[:-1] = ends[run]
    return s


def _spread(sa, found, symbols, heads, step) -> None:
    """Puts `found`, in order, at the heads (step 1) or tails (step -1) of their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    counts = np.bincount(ranked, minlength=len(heads))
    nth = np.arange(len(ranked)) - np.repeat(np.cumsum(counts) - counts, counts)
    sa[heads[ranked] + step * nth] = found[order]
    heads += step * counts


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array induced from LMS suffixes in (some) order; whole buckets are scanned at once."""
    n = len(t)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    # the last suffix of a text is of type L here and preceded in its bucket by nothing smaller
    in_bucket = np.bincount(t[lms], minlength=len(sizes))
    tail = ends - in_bucket
    sa[np.repeat(tail - (np.cumsum(in_bucket) - in_bucket), in_bucket) + np.arange(len(lms))] = lms
    heads = starts.copy()
    _spread(sa, np.array([n - 1]), t[n - 1 :], heads, 1)
    for c in np.flatnonzero(sizes):
        at = starts[c]
        while at < heads[c]:
            block = sa[at : heads[c]]
            at = heads[c]
            found = block[block > 0] - 1
            found = found[~s[found]]
            if len(found):
                _spread(sa, found, t[found], heads, 1)
        if in_bucket[c]:
            found = sa[tail[c] : ends[c]] - 1
            found = found[found >= 0]
            found = found[~s[found]]
            if len(found):
                _spread(sa, found, t[found], heads, 1)
    for c in np.flatnonzero(in_bucket):
        sa[tail[c] : ends[c]] = -1
    tails = ends - 1
    for c in np.flatnonzero(sizes)[::-1]:
        at = ends[c] - 1
        while at > tails[c]:
            block = sa[tails[c] + 1 : at + 1][::-1]
            at = tails[c]
            found = block[block > 0] - 1
            found = found[s[found]]
            if len(found):
                _spread(sa, found, t[found], tails, -1)
        block = sa[starts[c] : heads[c]][::-1]
        found = block[block > 0] - 1
        found = found[s[found]]
        if len(found):
            _spread(sa, found, t[found], tails, -1)
    return sa


def _induce_rows(t: list[int], s: list[bool], lms: list[int], starts: list[int], ends: list[int]) -> list[int]:
    """As _induce, suffix by suffix, for the many symbols of the names."""
    n = len(t)
    sa = [-1] * n
    at = ends[:]
    for i in reversed(lms):
        c = t[i]
        at[c] -= 1
        sa[at[c]] = i
    heads = starts[:]
    c = t[n - 1]
    sa[heads[c]] = n - 1
    heads[c] += 1
    for i in sa:  # what the loop puts further on, it meets there
        if i > 0 and not s[i - 1]:
            i -= 1
            c = t[i]
            k = heads[c]
            sa[k] = i
            heads[c] = k + 1
    at = ends[:]
    for i in reversed(sa):
        if i > 0 and s[i - 1]:
            i -= 1
            c = t[i]
            at[c] = k = at[c] - 1
            sa[k] = i
    return sa


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of t, whose values lie in 0 .. symbols - 1; a suffix precedes those that it begins."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    sizes = np.bincount(t, minlength=symbols)
    wide = symbols > 1024
    if wide:
        rows, kinds = t.tolist(), s.tolist()
        ends = np.cumsum(sizes)
        bounds = (ends - sizes).tolist(), ends.tolist()
    if not len(lms):
        return np.array(_induce_rows(rows, kinds, [], *bounds)) if wide else _induce(t, s, lms, sizes)
    if wide:
        sa = np.array(_induce_rows(rows, kinds, lms.tolist(), *bounds))
    else:
        order = np.argsort(t[lms], kind="stable")
        sa = _induce(t, s, lms[order], sizes)
    # names of the LMS substrings, in their sorted order
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = sa[is_lms[sa]]
    nth = np.zeros(n, np.int64)
    nth[lms] = np.arange(len(lms))
    upto = np.append(lms[1:], n - 1)
    length = (upto - lms + 1)[nth[sorted_lms]]
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length[:-1] == length[1:]
    same &= (upto[nth[a]] != n - 1) & (upto[nth[b]] != n - 1)
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        alike = t[a[open_] + k] == t[b[open_] + k]
        same[open_[~alike]] = False
        open_ = open_[alike]
        k += 1
        open_ = open_[length[open_] > k]
    names = np.append(0, np.cumsum(~same))
    reduced = np.zeros(len(lms), np.int64)
    reduced[nth[sorted_lms]] = names
    if names[-1] + 1 < len(lms):
        sorted_lms = lms[suffix_array(reduced, int(names[-1]) + 1)]
    if wide:
        return np.array(_induce_rows(rows, kinds, sorted_lms.tolist(), *bounds))
    return _induce(t, s, sorted_lms[np.argsort(t[sorted_lms], kind="stable")], sizes)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix of its suffix and the one before it in sa, up to the next 0.

    Only positions whose left neighbour differs from that of the suffix before are compared; elsewhere the length is one
    less than that of the position before.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    follows = (i > 0) & (phi > 0)
    follows[follows] = (t[i[follows] - 1] == t[phi[follows] - 1]) & (t[i[follows] - 1] != 0)
    first = np.flatnonzero(~follows)
    padded = np.concatenate([t.astype(np.uint16), np.zeros(9, np.uint16)])
    length = np.zeros(len(first), np.int64)
    x, y = first, phi[first]
    open_ = np.flatnonzero(y >= 0)
    while len(open_):
        p, q = x[open_] + length[open_], y[open_] + length[open_]
        alike = np.ones(len(open_), bool)
        for k in range(8):
            inside = np.flatnonzero(alike)
            u, v = padded[p[inside] + k], padded[q[inside] + k]
            good = (u == v) & (u != 0)
            length[open_[inside[good]]] += 1
            alike[inside[~good]] = False
        open_ = open_[alike]
    at = np.searchsorted(first, i, side="right") - 1
    return np.maximum(0, length[at] - (i - first[at]))
