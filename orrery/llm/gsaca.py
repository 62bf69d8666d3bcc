"""Suffix arrays by linear grouping construction, in plain Python over integer symbols.

Suffixes lie in groups that share a prefix, at first their first symbol; groups lie in order. Groups are processed in
descending order. For every suffix of a group the previous-smaller pointer is the nearest suffix to its left in a lower
group; the prefix of the suffix pointed at ends where the processed ones begin, so it grows by them, and it moves up within
its own group: behind those that were not pointed at, and the further the more copies follow it. At the end a group is a
Lyndon prefix. Then the order is emitted from the smallest suffix on: the suffix before an emitted one, and those that its
pointers lead to, come next in their groups. Nothing is renamed and no shorter string is sorted in between.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of text in ascending order; a proper prefix comes before what extends it."""
    n = len(text) + 1  # with an end that is below every symbol
    if n == 1:
        return []
    order = sorted(range(n - 1), key=text.__getitem__)
    order.insert(0, n - 1)
    start = [0] * n  # of each suffix's group, as its index in order
    place = [0] * n
    size = {0: 1}
    last, at = None, 1
    for i in range(1, n):
        s = order[i]
        if text[s] != last:
            last, at = text[s], i
            size[at] = 0
        start[s] = at
        place[s] = i
        size[at] += 1
    before = [-1] * n
    end = n
    while end > 1:
        at = start[order[end - 1]]
        members = order[at:end]
        if end - at > 1:
            members.sort()
        count: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and start[p] >= at:
                p = before[p]
            before[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            most = max(count.values())
            levels = [count] if most == 1 else [[p for p, c in count.items() if c == k] for k in range(most, 0, -1)]
            for level in levels:
                moved: dict[int, int] = {}
                for p in level:  # to the end of what is left of its group
                    g = start[p]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    j = g + size[g] - m
                    i = place[p]
                    q = order[j]
                    order[i], order[j] = q, p
                    place[q], place[p] = i, j
                for g, m in moved.items():
                    rest = size[g] - m
                    if rest:
                        size[g] = rest
                        new = g + rest
                        size[new] = m
                        for j in range(new, new + m):
                            start[order[j]] = new
        end = at
    out = [0] * n
    out[0] = n - 1
    following = list(range(n))  # the next free index of a group, at its start
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            done[s] = 1
            g = start[s]
            out[following[g]] = s
            following[g] += 1
            s = before[s]
    return out[1:]
