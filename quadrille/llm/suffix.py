"""Suffix arrays by induced sorting, and permuted longest-common-prefix arrays.

The steps of SA-IS, each a sequence of numpy passes over a symbol's bucket instead of a
loop over suffixes: classify suffixes; sort the leftmost-smaller (LMS) substrings by
inducing from unsorted LMS positions; name them; sort the reduced string of names; induce
the whole array from the sorted LMS suffixes. The reduced string has as many symbols as
names, where buckets no longer pay, so the recursion sorts it by doubling, refining only
entries that still tie.
"""

from __future__ import annotations

import numpy as np

from quadrille.llm.textops import span_hashes


def classify(text: np.ndarray) -> np.ndarray:
    """S-type (True) or L-type of every suffix; text ends with its only 0."""
    n = len(text)
    less = np.empty(n, bool)
    less[:-1] = text[:-1] < text[1:]
    less[-1] = True
    decided = np.empty(n, bool)
    decided[:-1] = text[:-1] != text[1:]
    decided[-1] = True
    at = np.flatnonzero(decided)
    return np.repeat(less[at], np.diff(np.concatenate([[-1], at])))


def _deal(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, the rank of each within its symbol, counts."""
    order = np.argsort(symbols, kind="stable")
    count = np.bincount(symbols, minlength=size)
    first = np.cumsum(count) - count
    return order, np.arange(len(symbols)) - first[symbols[order]], count


def _induce(text, s_type, lms, start, end, n_l, present):
    """The suffix array induced from LMS positions, sorted within each symbol's bucket."""
    size = len(start)
    sa = np.empty(len(text), np.int32)
    l_type, s_only = ~s_type, s_type.copy()
    s_only[-1] = False  # also answers for the suffix before the first
    lms_order, _, lms_count = _deal(text[lms], size)
    lms = lms[lms_order]
    lms_end = np.cumsum(lms_count)
    head = start.copy()

    def push_l(found):
        before = found - 1
        before = before[l_type[before]]
        if len(before):
            symbol = text[before]
            order, rank, count = _deal(symbol, size)
            sa[head[symbol[order]] + rank] = before[order]
            head[:] += count

    for c in present:
        low = start[c]
        while head[c] > low:
            wave, low = sa[low : head[c]], head[c]
            push_l(wave)
        if lms_count[c]:
            push_l(lms[lms_end[c] - lms_count[c] : lms_end[c]])

    tail = end.copy()

    def push_s(found):
        before = found - 1
        before = before[s_only[before]]
        if len(before):
            symbol = text[before]
            order, rank, count = _deal(symbol, size)
            sa[tail[symbol[order]] - 1 - rank] = before[order]
            tail[:] -= count

    sa[0] = len(text) - 1
    for c in present[::-1]:
        high = end[c]
        while tail[c] < high and c:
            wave, high = sa[tail[c] : high][::-1], tail[c]
            push_s(wave)
        if n_l[c]:
            push_s(sa[start[c] : start[c] + n_l[c]][::-1])
    return sa


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names by doubling; only tied entries are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            return order
        who = order[place]
        after = np.where(who + step < n, rank[np.minimum(who + step, n - 1)] + 1, 0)
        key = (rank[who].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[place] = who
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[place] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, place, 0))
        step *= 2


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of bytes (without the empty suffix)."""
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int32)
    text = np.empty(n + 1, np.int16)
    text[:n] = data
    text[:n] += 1
    text[n] = 0
    s_type = classify(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]).astype(np.int32) + np.int32(1)
    count = np.bincount(text, minlength=257)
    end = np.cumsum(count)
    start = end - count
    n_l = np.bincount(text[~s_type], minlength=257)
    present = np.flatnonzero(count)
    sa = _induce(text, s_type, lms, start, end, n_l, present)
    if len(lms) > 1:
        is_lms = np.zeros(n + 1, bool)
        is_lms[lms] = True
        by_substring = sa[is_lms[sa]]
        number = np.empty(n + 1, np.int32)
        number[lms] = np.arange(len(lms), dtype=np.int32)
        stop = np.append(lms[1:] + 1, n + 1).astype(np.int64)  # an LMS substring runs to the next LMS position
        digest = span_hashes(np.append(data, np.uint8(0)), lms.astype(np.int64), np.minimum(stop, n + 1))
        digest[-1] = 0  # the sentinel's own
        size = stop - lms
        k = number[by_substring]
        new = np.concatenate([[True], (digest[k[1:]] != digest[k[:-1]]) | (size[k[1:]] != size[k[:-1]]) | (k[1:] >= len(lms) - 2) | (k[:-1] >= len(lms) - 2)])
        names = np.empty(len(lms), np.int64)
        names[k] = np.cumsum(new)
        order = _sort_names(names)
        sa = _induce(text, s_type, lms[order], start, end, n_l, present)
    return sa[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PLCP: for each position, the bytes its suffix shares with the suffix before it in
    the array, and that suffix's position (-1: none). Only irreducible values - where the
    preceding bytes differ - are compared; the others follow by one less a step."""
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    if n < 2:
        return plcp, phi
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (phi[1:] > 0) & (data[at[1:] - 1] == data[np.maximum(phi[1:] - 1, 0)])
    who = np.flatnonzero(~reducible)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live = who[phi[who] >= 0]
    a, b = live.copy(), phi[live]
    while len(live):
        room = np.minimum(n - a, n - b)
        same = eight[a] == eight[b]
        full = same & (room >= 8)
        part = live[~full]
        if len(part):
            x, y, most = a[~full].copy(), b[~full].copy(), room[~full]
            differ = eight[x] ^ eight[y]
            low = differ & (~differ + np.uint64(1))
            bits = np.where(differ == 0, 64, np.frexp(low.astype(np.float64))[1] - 1)
            plcp[part] += np.minimum(bits // 8, most)
        live, a, b = live[full], a[full] + 8, b[full] + 8
        plcp[live] += 8
        ended = np.minimum(n - a, n - b) <= 0
        if ended.any():
            live, a, b = live[~ended], a[~ended], b[~ended]
    last = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.where(reducible, plcp[last] - (at - last), plcp), phi
