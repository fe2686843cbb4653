"""Suffix array by linear grouping construction, over integers.

First, suffixes are grouped by their Lyndon prefixes. Groups are worked through from the highest to the lowest: every
suffix of a group looks up the nearest earlier suffix that is in a lower group (its previous smaller one, found by
following such pointers); those found append the group's prefix to their own, as often as they were found, and move to
a new group right behind their old one. Then the suffix array is emitted from the left: when a suffix is placed, the
suffixes whose Lyndon prefix ends where it begins take the next free place of their groups. Nothing is renamed.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Positions of ``text`` in the order of the suffixes that begin there; an end is smaller than any symbol."""
    if not text:
        return []
    text = [*text, min(text) - 1]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    start = [0] * n  # of each suffix's group
    size = [0] * (n + 1)  # by a group's start
    begin = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            begin = k
        place[i], start[i] = k, begin
        size[begin] += 1
    smaller = [-1] * n
    upto = n
    while upto > 0:
        g = start[order[upto - 1]]
        found: dict[int, int] = {}
        for i in sorted(order[g:upto]) if upto - g > 1 else order[g:upto]:
            p = i - 1
            while p >= 0 and start[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        upto = g
        if not found:
            continue
        if len(found) == 1:
            sets = [list(found)]
        else:
            by: dict[int, list[int]] = {}
            for p, times in found.items():
                by.setdefault(times, []).append(p)
            sets = [by[times] for times in sorted(by, reverse=True)]
        for some in sets:
            moved: dict[int, int] = {}
            for p in some:
                s = start[p]
                count = moved.get(s, 0) + 1
                moved[s] = count
                at, last = place[p], s + size[s] - count
                if at != last:
                    other = order[last]
                    order[at], order[last] = other, p
                    place[other], place[p] = at, last
            for s, count in moved.items():
                if count == size[s]:
                    continue
                size[s] -= count
                fresh = s + size[s]
                size[fresh] = count
                for k in range(fresh, fresh + count):
                    start[order[k]] = fresh
    # a suffix's Lyndon prefix ends at the next smaller suffix: the one that removes it from the stack of open ones
    ended: list[list[int]] = [[]] * n
    open_: list[int] = []
    for i in range(n):
        p, ends = smaller[i], []
        while open_ and open_[-1] != p:
            ends.append(open_.pop())
        ended[i] = ends
        open_.append(i)
    out, head = [n - 1] * n, list(range(n))
    for k in range(n):
        for i in ended[out[k]]:
            g = start[i]
            out[head[g]] = i
            head[g] += 1
    return out[1:]
