"""Suffix arrays by linear grouping."""

from __future__ import annotations

UNSEEN = -2


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in order.

    Grouping: suffixes start in groups of equal first symbol and are taken group by group, the highest first. For each
    member the pointer leads to the nearest position before it whose group is still lower. The positions so found are
    followed by the Lyndon prefix of the group; those of one group and the same number of such followers move to a new
    group just above their old one, so every group ends as the suffixes that share their longest Lyndon prefix.

    Emission: walking the finished array upward from the empty suffix, the position before each emitted suffix and the
    positions its pointers lead to are next in their groups. No suffix is renamed and nothing recurses.
    """
    n = len(text)
    names = {c: g for g, c in enumerate(sorted(set(text)))}
    group = [names[c] for c in text]
    members: list[list[int]] = [[] for _ in names]
    for s, g in enumerate(group):
        members[g].append(s)
    size = [len(m) for m in members]
    lower = list(range(-1, len(members) - 1))
    upper = [*range(1, len(members)), -1]
    before = [UNSEEN] * n
    falling: list[int] = []
    g = len(members) - 1
    while g >= 0:
        falling.append(g)
        followers: dict[int, int] = {}
        for s in members[g]:
            if group[s] != g:
                continue  # moved up since
            p = s - 1
            while p >= 0 and before[p] != UNSEEN:
                p = before[p]
            before[s] = p
            if p >= 0:
                followers[p] = followers.get(p, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, c in followers.items():
            parts.setdefault((c, group[p]), []).append(p)
        for c, old in sorted(parts, reverse=True) if len(parts) > 1 else parts:
            moved = parts[c, old]
            if len(moved) == size[old]:
                continue  # all that is left of the group stays together
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            above = upper[old]
            lower.append(old)
            upper.append(above)
            upper[old] = new
            lower[above] = new
            for p in moved:
                group[p] = new
        g = lower[g]
    free = [0] * len(members)
    at = 0
    for g in reversed(falling):
        free[g] = at
        at += size[g]
    out = [n] * n
    placed = bytearray(n)
    s = n - 1
    for k in range(-1, n):
        s = (n if k < 0 else out[k]) - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = before[s]
    return out
