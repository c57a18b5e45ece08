"""Suffix sorting by linear grouping (Baier, 2016).

First phase: suffixes start out grouped by their first symbol.  Groups are processed in descending
order; for each suffix of a group the nearest earlier suffix of a lower group is its previous
smaller one.  A suffix that is pointed at by l suffixes of the group goes on with l copies of the
group's prefix, so those with the same l leave their group together and form the next higher one.
In the end a group holds the suffixes with one Lyndon prefix.  Second phase: suffixes are emitted
in ascending order; each one, and the chain of previous smaller ones before it, takes the next place
of its group.  Nothing is renamed and no smaller problem is sorted recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (integers of any size) in ascending order.

    A suffix that is a prefix of another comes before it.
    """
    n = len(symbols) + 1
    text = np.empty(n, np.int64)
    text[:-1] = np.unique(symbols, return_inverse=True)[1] + 1
    text[-1] = 0  # the end, smaller than every symbol
    first = np.argsort(text, kind="stable")
    heads = np.r_[True, text[first[1:]] != text[first[:-1]]]
    starts = np.flatnonzero(heads)
    group_np = np.empty(n, np.int64)
    group_np[first] = starts[np.cumsum(heads) - 1]
    size_np = np.zeros(n, np.int64)
    size_np[starts] = np.diff(np.r_[starts, n])
    place_np = np.empty(n, np.int64)
    place_np[first] = np.arange(n)
    order, group, size, place = first.tolist(), group_np.tolist(), size_np.tolist(), place_np.tolist()

    smaller = [-1] * n  # the previous smaller suffix
    jump = [-1] * n  # the same with shortened paths
    high = n
    while high > 0:
        low = group[order[high - 1]]
        members = order[low:high]
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            if p >= 0 and group[p] >= low:
                path = []
                while p >= 0 and group[p] >= low:
                    path.append(p)
                    p = jump[p]
                for q in path:
                    jump[q] = p
            smaller[i] = jump[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        high = low
        if not pointed:
            continue
        for times in sorted(set(pointed.values()), reverse=True):
            leaving: dict[int, int] = {}
            for p, count in pointed.items():
                if count == times:
                    home = group[p]
                    gone = leaving.get(home, 0) + 1
                    leaving[home] = gone
                    to, at = home + size[home] - gone, place[p]
                    other = order[to]
                    order[to], order[at] = p, other
                    place[p], place[other] = to, at
            for home, gone in leaving.items():
                left = size[home] - gone
                if left:
                    new = home + left
                    size[home], size[new] = left, gone
                    for k in range(new, new + gone):
                        group[order[k]] = new

    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            own = group[j]
            out[free[own]] = j
            free[own] += 1
            placed[j] = 1
            j = smaller[j]
    return np.array(out[1:], np.int64)


def prefix_classes(symbols: np.ndarray, order: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length 1..``longest``: a class for every suffix, equal for equal prefixes of that length.

    Suffixes shorter than the length are in classes of their own.
    """
    n, out = len(symbols), []
    same = np.ones(max(0, n - 1), bool)
    for k in range(longest):
        a, b = order[1:] + k, order[:-1] + k
        inside = (a < n) & (b < n)
        same = same & inside
        same[same] = symbols[a[same]] == symbols[b[same]]
        by_rank = np.concatenate([[0], np.cumsum(~same)]) if n else np.zeros(0, np.int64)
        own = np.empty(n, np.int64)
        own[order] = by_rank
        out.append(own)
    return out
