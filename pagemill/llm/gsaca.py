"""Suffix sorting by linear grouping construction.

Phase 1 takes the suffix groups from the highest to the lowest. Each suffix of a group looks
up its previous smaller suffix (the nearest one to the left in a lower group); those are
taken out of their groups and put right behind them, the more often pointed to the higher,
so that in the end suffixes are grouped by their Lyndon prefixes. Phase 2 walks the order
from the left and follows the previous-smaller pointers of the suffix before each: every
suffix met takes the next free place of its group. No rank is ever computed anew.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Order of all suffixes of `s`, whose last symbol must be smaller than every other."""
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)  # stable: ascending positions within a symbol
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for p, i in enumerate(order):
        if p and s[i] != s[order[p - 1]]:
            start = p
        place[i], group[i] = p, start
        size[start] += 1
    before = [-1] * n  # previous smaller suffix

    def behind(members: list[int], old: int) -> None:
        """Make `members` of the group at `old` a group of its own right behind what is left of it."""
        m = size[old]
        if m == len(members):
            return
        new = old + m
        for j in members:
            new -= 1
            p, other = place[j], order[new]
            order[new], order[p] = j, other
            place[j], place[other] = new, p
        for j in members:
            group[j] = new
        size[old], size[new] = new - old, len(members)

    end = n
    while end:
        g = group[order[end - 1]]
        if end - g == 1:
            i = order[g]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0 and size[group[j]] > 1:
                behind([j], group[j])
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[g:end]):
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, k in pointed.items():
                by_count.setdefault(k, {}).setdefault(group[j], []).append(j)
            for k in sorted(by_count, reverse=True):
                # a group may have moved no start since, but members of higher counts have left it
                for old, members in by_count[k].items():
                    behind(members, old)
        end = g

    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))  # next place of the group that starts here
    done = bytearray(n)
    done[n - 1] = 1
    free[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = before[j]
    return out
