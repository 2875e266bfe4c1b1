"""Suffix array by grouping, in linear time and without recursive renaming."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order; a suffix that ends sooner is smaller.

    First the suffixes are grouped by their longest Lyndon prefix.  Groups are taken in descending order; each
    suffix of a group finds its previous smaller suffix by following pointers already known, and those
    found move behind the rest of their own group, further the more of the current group's suffixes point to
    them.  Then, in ascending order, each suffix hands the next place of its group to the suffix before it and
    to the suffixes reached from there by the previous-smaller pointers.
    """
    n = len(symbols) + 1
    text = np.zeros(n, dtype=np.int64)  # the last entry is smaller than all symbols
    text[:-1] = np.unique(symbols, return_inverse=True)[1] + 1
    order = np.argsort(text, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = text[order[1:]] != text[order[:-1]]
    begin = np.flatnonzero(first)
    run = np.repeat(begin, np.diff(np.append(begin, n)))
    where, group = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    where[order], group[order] = np.arange(n), run
    size = dict(zip(begin.tolist(), np.diff(np.append(begin, n)).tolist()))
    sa, where, group = order.tolist(), where.tolist(), group.tolist()
    smaller = _group(sa, where, group, size)
    return np.array(_order(n, group, smaller)[1:], dtype=np.int64)


def _group(sa: list[int], where: list[int], group: list[int], size: dict[int, int]) -> list[int]:
    """Refines ``group`` (start of each suffix's group in ``sa``) and returns the previous-smaller pointers."""
    smaller = [-1] * len(sa)
    end = len(sa)
    while end:
        start = group[sa[end - 1]]
        members = sa[start:end] if end - start == 1 else sorted(sa[start:end])
        end = start
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0:
                g = group[p]
                if g < start:
                    pointed[p] = pointed.get(p, 0) + 1
                    break
                p = smaller[p]
                if g == start:  # the same group: its pointer leads below the group at once
                    if p >= 0:
                        pointed[p] = pointed.get(p, 0) + 1
                    break
            smaller[i] = p
        if not pointed:
            continue
        levels: dict[int, list[int]] = {}
        for p, times in pointed.items():
            levels.setdefault(times, []).append(p)
        for times in sorted(levels, reverse=True):
            parts: dict[int, list[int]] = {}
            for p in levels[times]:
                parts.setdefault(group[p], []).append(p)
            for g, moved in parts.items():
                rest = size[g] - len(moved)
                if not rest:
                    continue
                at = g + size[g]
                size[g] = rest
                size[g + rest] = len(moved)
                for p in moved:
                    at -= 1
                    other, place = sa[at], where[p]
                    sa[place], where[other] = other, place
                    sa[at], where[p] = p, at
                    group[p] = g + rest
    return smaller


def _order(n: int, group: list[int], smaller: list[int]) -> list[int]:
    """Suffix order from the groups; the empty suffix comes first."""
    out, placed, filled = [0] * n, [False] * n, [0] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            placed[j] = True
            j = smaller[j]
    return out
