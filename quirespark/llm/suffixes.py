"""Suffix arrays by induced sorting, and permuted common prefixes; in numpy, many suffixes at a time.

Suffixes smaller than their successor are of type S, the others of type L; an S behind an L is leftmost-smaller (LMS).
The LMS suffixes in order induce the order of the L suffixes in front of them, and these that of the S suffixes. induced() walks
the buckets of first symbols upwards (for S: downwards). All that a bucket holds hands its predecessors on in one step; those
that fall into the same bucket follow in further steps, as many as the longest run of one symbol.

The LMS suffixes are sorted first: the substrings from one LMS position to the next are sorted by the same induction and named by
rank; if names repeat, the string of names is sorted by recursion. Names are too many for a step each: neighbouring ones share a
bucket, and what is induced within it is inserted where its successor's place says.
"""

from __future__ import annotations

import numpy as np


def is_s(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is not, as the end comes before every byte."""
    n = len(t)
    out = np.zeros(n, bool)
    if n > 1:
        change = np.nonzero(t[1:] != t[:-1])[0]
        rising = t[change] < t[change + 1]
        reach = np.searchsorted(change, np.arange(change[-1] + 1)) if len(change) else np.zeros(0, np.int64)
        out[: len(reach)] = rising[reach]
    return out


#: Most buckets, and symbols that make a bucket worth a step.
BUCKETS, WORTH = 256, 500


def induced(t: np.ndarray, mine: np.ndarray, seeds: np.ndarray, first: int | None = None) -> np.ndarray:
    """The suffixes that are mine, in order, behind the seeds, those of the other kind in order; within a symbol mine come first.

    t may be complemented, so that both kinds are induced upwards. first: a suffix that what is smaller than all hands on.
    """
    n = len(t)
    size = np.bincount(t)
    buckets = BUCKETS if t.dtype == np.uint8 else min(BUCKETS, n // WORTH + 1)
    bucket_of = np.arange(len(size)) if len(size) <= buckets else np.cumsum(size) * (buckets - 1) // n
    bucket = bucket_of.astype(np.uint8)[t]
    symbols = np.bincount(bucket_of[size > 0], minlength=buckets).tolist()
    room = np.bincount(bucket[mine], minlength=buckets)
    start = np.cumsum(room) - room
    head = start.copy()
    out = np.zeros(int(room.sum()), np.int64)
    edge = np.searchsorted(bucket[seeds], np.arange(buckets + 1)).tolist()
    place = np.zeros(n + 1, np.int64)
    if first is not None:
        out[head[bucket[first]]] = first
        head[bucket[first]] += 1

    def before(of: np.ndarray) -> np.ndarray:
        at = of[of > 0] - 1
        return at[mine[at]]

    def hand_on(of: np.ndarray, c: int) -> None:
        at = before(of)
        b = bucket[at]
        by = np.argsort(b[later := b > c], kind="stable")
        at, b = at[later][by], b[later][by]
        count = np.bincount(b, minlength=buckets)
        out[np.repeat(head - np.cumsum(count) + count, count) + np.arange(at.size)] = at
        head[:] += count

    for c in range(buckets):
        if not symbols[c]:
            continue
        own, held = seeds[edge[c] : edge[c + 1]], out[start[c] : head[c]]
        if symbols[c] == 1:
            parts = [held]
            while parts[-1].size:
                at = before(parts[-1])
                parts.append(at[bucket[at] == c])
            held = np.concatenate(parts)
            order = np.concatenate((held, own))
        else:
            order = np.concatenate((held, own))
            order = order[np.argsort(2 * t[order].astype(np.int64) + ~mine[order], kind="stable")]
            inside = np.zeros(0, np.int64)
            new = before(order)
            new = new[bucket[new] == c]
            while new.size:
                inside = np.concatenate((inside, new))
                place[order] = np.arange(1, len(order) + 1)
                behind = np.zeros(len(order), np.int64)
                if len(inside) > len(new):
                    old = inside[: -len(new)]
                    behind[place[old] - 1] = place[old + 1]
                key = (2 * t[order].astype(np.int64) + ~mine[order]) * (n + 1) + behind
                new_key = 2 * t[new].astype(np.int64) * (n + 1) + place[new + 1]
                by = np.argsort(new_key, kind="stable")
                at = np.searchsorted(key, new_key[by], side="right") + np.arange(len(new))
                others = np.ones(len(order) + len(new), bool)
                others[at] = False
                grown = np.empty(len(others), np.int64)
                grown[at], grown[others] = new[by], order
                order = grown
                new = before(new)
                new = new[bucket[new] == c]
            held = order[mine[order]]
        out[start[c] : start[c] + len(held)] = held
        head[c] = start[c] + len(held)
        hand_on(order, c)
    return out


def induce(t: np.ndarray, s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array, given the LMS positions in order (of any order within a first symbol: then LMS substrings come out in order)."""
    seeds = seeds[np.argsort(t[seeds], kind="stable")]
    large = induced(t, ~s, seeds, len(t) - 1)
    turned = (int(t.max()) - t).astype(t.dtype)
    small = induced(turned, s, large[::-1])[::-1]
    # both are in order; within a symbol L comes before S
    both = np.r_[large, small]
    return both[np.argsort(t[both], kind="stable")]


def named(t: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring (by position in the text); equal ones have one rank. order: the LMS positions sorted by substring."""
    place = np.searchsorted(lms, order)
    length = np.diff(np.r_[lms, len(t)])[place]
    same = length[1:] == length[:-1]
    same &= (place[1:] != len(lms) - 1) & (place[:-1] != len(lms) - 1)  # the last one has the end in it
    pairs, o = np.nonzero(same)[0], 0
    while pairs.size:
        differ = t[order[pairs] + o] != t[order[pairs + 1] + o]
        same[pairs[differ]] = False
        pairs = pairs[~differ]
        pairs = pairs[length[pairs] > o]
        o += 1
    rank = np.empty(len(lms), np.int64)
    rank[place] = np.cumsum(np.r_[True, ~same]) - 1
    return rank


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of t (bytes or names) in order, as positions; a suffix comes before those that it begins."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = is_s(t)
    lms = np.nonzero(s[1:] & ~s[:-1])[0] + 1
    if len(lms) > 1:
        at_lms = np.zeros(n, bool)
        at_lms[lms] = True
        by_substring = induce(t, s, lms)
        rank = named(t, by_substring[at_lms[by_substring]], lms)
        if rank.max() + 1 == len(lms):
            order = np.argsort(rank)
        else:
            order = suffix_array(rank)
        lms = lms[order]
    return induce(t, s, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix before its own in order (-1: none), and the length of their common prefix.

    Where both are behind equal bytes the length is that of the position before, less one; the others are compared, eight bytes at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    known = (at > 0) & (phi > 0)
    known[known] = t[at[known] - 1] == t[phi[known] - 1]
    start = np.nonzero(~known & (phi >= 0))[0]
    length = np.zeros(n, np.int64)
    padded = np.r_[t, np.zeros(8, np.uint8)]
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    a, b, of = start.copy(), phi[start], start
    while a.size:
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = np.minimum(np.where(x == 0, 8, np.log2((x & -x).astype(np.float64) + (x == 0)).astype(np.int64) // 8), n - np.maximum(a, b))
        length[of] += same
        on = (same == 8) & (np.maximum(a, b) + 8 < n)
        a, b, of = a[on] + 8, b[on] + 8, of[on]
    origin = np.maximum.accumulate(np.where(known, 0, at))
    return phi, np.where(phi >= 0, length[origin] - (at - origin), 0)
