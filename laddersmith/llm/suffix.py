"""Suffix arrays by induced sorting over numpy arrays, and permuted common prefixes.

Suffixes are classed S or L; leftmost S suffixes (LMS) split the text into substrings that
one induced pass sorts and names; the string of names is sorted recursively, and a second
pass induces the whole array from it (Nong, Zhang and Chan, 2009). A pass goes over the
buckets of the alphabet: a bucket's entries induce their predecessors together, in waves for
those that fall into the same bucket. Where the names are too many for buckets, the
recursion ends in prefix doubling.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that is sorted by buckets.
BUCKETS = 2048


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S: smaller than its right neighbour. The last symbol is the least and unique."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        change = np.flatnonzero(t[:-1] != t[1:])  # the ends of runs of one symbol
        s[: n - 1] = np.repeat(t[change] < t[change + 1], np.diff(change, prepend=-1))
    return s


def _deal(t: np.ndarray, pred: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append each entry to its symbol's bucket, in order."""
    if not len(pred):
        return
    ch = t[pred]
    o = np.argsort(ch, kind="stable")
    ch, pred = ch[o], pred[o]
    cut = np.flatnonzero(ch[1:] != ch[:-1]) + 1
    for part, c in zip(np.split(pred, cut), ch[np.concatenate([[0], cut])].tolist(), strict=True):
        into[c].append(part)


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The array induced from LMS suffixes given in order."""
    start: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(t, lms, start)
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    none = np.zeros(0, np.int64)
    for c in range(size):
        here = np.concatenate(large[c]) if large[c] else none
        done = []
        while len(here):
            done.append(here)
            pred = here[here > 0] - 1
            pred = pred[~s[pred]]
            same = t[pred] == c
            _deal(t, pred[~same], large)
            here = pred[same]
        large[c] = done
        if start[c]:
            first = np.concatenate(start[c])
            pred = first[first > 0] - 1
            _deal(t, pred[~s[pred]], large)
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size - 1, -1, -1):
        here = np.concatenate(small[c]) if small[c] else none
        done = []
        while len(here):
            done.append(here)
            pred = here[here > 0] - 1
            pred = pred[s[pred]]
            same = t[pred] == c
            _deal(t, pred[~same], small)
            here = pred[same]
        small[c] = done
        if large[c]:
            whole = np.concatenate(large[c])[::-1]
            pred = whole[whole > 0] - 1
            _deal(t, pred[s[pred]], small)
    small[int(t[-1])].append(np.array([len(t) - 1]))  # nothing induces the last suffix
    out = []
    for c in range(size):
        out += large[c]
        if small[c]:
            out.append(np.concatenate(small[c])[::-1])
    return np.concatenate(out)


def _doubling(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling over the suffixes whose rank is still shared."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], t[order][1:] != t[order][:-1]])
    at = np.flatnonzero(new)
    rank[order] = at[np.cumsum(new) - 1]  # a group's rank is its first place
    h = 1
    while len(at) < n:
        size = np.diff(np.append(at, n))
        place = np.flatnonzero(np.repeat(size > 1, size))
        who = order[place]
        nxt = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        o = np.lexsort((nxt, rank[who]))
        who, nxt = who[o], nxt[o]
        order[place] = who
        r = rank[who]
        first = np.concatenate([[True], (r[1:] != r[:-1]) | (nxt[1:] != nxt[:-1])])
        new[place] = first
        at = np.flatnonzero(new)
        rank[who] = place[np.flatnonzero(first)[np.cumsum(first) - 1]]
        h *= 2
    return order


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of ``t`` (symbols below ``size``; its last symbol is 0 and stands nowhere else)."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    if size > BUCKETS:
        return _doubling(t)
    t = t.astype(np.uint16)  # short symbols are dealt by radix
    s = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return _induce(t, s, lms, size)
    got = _induce(t, s, lms, size)
    got = got[is_lms[got]]
    # names: equal where the substrings up to the next LMS place are equal
    nth = np.zeros(n, np.int64)
    nth[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms) + 1, 1)
    ln = length[nth[got]]
    same = ln[1:] == ln[:-1]
    todo = np.flatnonzero(same)
    k = 0
    while len(todo):
        eq = t[got[todo] + k] == t[got[todo + 1] + k]
        same[todo[~eq]] = False
        todo = todo[eq & (k + 1 < ln[todo])]
        k += 1
    name = np.zeros(len(got), np.int64)
    np.cumsum(~same, out=name[1:])
    if name[-1] + 1 == len(lms):
        return _induce(t, s, got, size)
    reduced = np.empty(len(lms), np.int64)
    reduced[nth[got]] = name
    return _induce(t, s, lms[suffix_array(reduced, int(name[-1]) + 1)], size)


def permuted_prefixes(data: np.ndarray, end: np.ndarray, sa: np.ndarray, cap: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(places, prefixes): for each place p in text order its predecessor in the array, and the length that both share.

    ``data``: bytes; ``end``: for each place, where its string ends. Lengths stop at ``cap``; they are 0 where one of the two has
    fewer than ``least`` bytes left.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(wide, 8)[: n + 1]
    out = np.zeros(n, np.int64)
    p = np.flatnonzero(phi >= 0)
    q = phi[p]
    most = np.minimum(np.minimum(end[p] - p, end[q] - q), cap)
    p, q, most = p[most >= least], q[most >= least], most[most >= least]
    at = np.zeros(len(p), np.int64)
    live = np.flatnonzero(most > 0)
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    while len(live):
        x = eight[np.minimum(p[live] + at[live], n)] ^ eight[np.minimum(q[live] + at[live], n)]
        eq = x == 0
        miss = live[~eq]
        if len(miss):
            y = x[~eq]
            low = y & (~y + np.uint64(1))
            at[miss] += np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        live = live[eq]
        at[live] += 8
        live = live[at[live] < most[live]]
    out[p] = np.minimum(at, most)
    return phi, out


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, the starts whose next ``least`` bytes also start at another place of the strings."""
    if not strings:
        return []
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = data.astype(np.int64) + 2
    t[start[1:] - 1] = 1
    t = np.append(t, 0)
    used = np.bincount(t, minlength=258) > 0
    t = (np.cumsum(used) - 1)[t]
    sa = suffix_array(t, int(used.sum()))[1:]  # without the end mark
    end = np.repeat(start[1:] - 1, sizes + 1)
    phi, common = permuted_prefixes(data, end, sa, least, least)
    hit = np.zeros(len(data), bool)
    p = np.flatnonzero(common >= least)
    hit[p] = True
    hit[phi[p]] = True
    return [np.flatnonzero(hit[start[i] : start[i] + sizes[i]]) for i in range(len(strings))]
