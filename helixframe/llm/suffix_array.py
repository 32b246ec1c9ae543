"""Linear suffix grouping: a suffix array without recursion or renaming.

Phase 1 sorts suffixes into groups by their Lyndon prefixes. Groups are taken
in descending order; each suffix of a group points to the nearest suffix before
it in a lower group, and the suffixes pointed at rise above the rest of their
own groups, those pointed at more often higher. Phase 2 emits the order inside the
groups: following the finished order, the suffix before each placed one, and then
along its previous-smaller pointers all that are not placed yet, take the next place of their
groups.
"""

from __future__ import annotations

from itertools import accumulate


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes of a list of non-negative numbers in lexicographic order; a shorter prefix comes first."""
    n = len(symbols) + 1
    text = [s + 1 for s in symbols] + [0]  # a unique least end
    size = [0] * n
    counts: dict[int, int] = {}
    for s in text:
        counts[s] = counts.get(s, 0) + 1
    values = sorted(counts)
    first = dict(zip(values, accumulate([0, *(counts[v] for v in values)])))
    fill = dict(first)
    order, place, group = [0] * n, [0] * n, [0] * n
    for i, s in enumerate(text):
        at = fill[s]
        fill[s] = at + 1
        order[at], place[i], group[i] = i, at, first[s]
    for v in values:
        size[first[v]] = counts[v]

    prev = [-2] * n  # -2: not known yet; -1: nothing smaller before it
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        pointed: dict[int, int] = {}
        for i in order[start : end + 1]:
            p, passed = i - 1, [i]
            while p >= 0 and group[p] >= start:
                if prev[p] == -2:  # of this same group
                    passed.append(p)
                    p -= 1
                else:
                    p = prev[p]
            for q in passed:
                prev[q] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) > 1 or pointed:
            by_count: dict[int, list[int]] = {}
            for p, c in pointed.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                for p in by_count[c]:  # to the end of what is left of its group
                    g = group[p]
                    size[g] -= 1
                    at, to = place[p], g + size[g]
                    other = order[to]
                    order[to], order[at] = p, other
                    place[p], place[other] = to, at
                for p in by_count[c]:
                    g = group[p]
                    new = g + size[g]
                    group[p] = new
                for p in by_count[c]:
                    size[group[p]] += 1
        end = start - 1

    out = [0] * n
    front = group  # the next free place of the group that starts there, kept at its start
    following = list(range(n))
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = front[p]
            out[following[g]] = p
            following[g] += 1
            placed[p] = True
            p = prev[p]
    return out[1:]
