"""Suffix arrays by linear grouping (greedy suffix array construction by Lyndon groups).

Phase 1 keeps the suffixes in groups, ordered, of suffixes that share a prefix: at
first their first symbol, at the end their longest Lyndon prefix. Groups are
processed from the greatest down. Each suffix of the group points to the previous
suffix that is in a smaller group; the suffixes pointed at continue with the group's
prefix, as often as pointers meet there, and so move out of their groups into new ones right
behind, ordered by that number. Phase 2 emits: each suffix in order places the
suffix before it, and along its previous-smaller pointers all that follow, at the front
of their groups. No ranks are recomputed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of s in order; the last symbol must be the unique smallest."""
    n = len(s)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by.setdefault(c, []).append(i)
    # groups (as many as symbols at most): members, and the links of an ordered list (below[g], above[g])
    members: list[list[int]] = [by[c] for c in sorted(by)]
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    of, prev, alive = [0] * n, [-1] * n, [len(m) for m in members]
    for g, m in enumerate(members):
        for i in m:
            of[i] = g
    done = [False] * len(members)
    g = len(members) - 1
    while g > 0:  # the last symbol's group is the lowest, and never done: every chain of pointers ends there
        done[g] = True
        counts: dict[int, int] = {}
        own = members[g]
        if alive[g] != len(own):  # some have moved out
            own = members[g] = [i for i in own if of[i] == g]
        for i in own:
            j = i - 1
            while done[of[j]]:  # -1 stands for the last symbol, whose group is never done
                j = prev[j]
            prev[i] = j
            if j >= 0:
                if j in counts:
                    counts[j] += 1
                else:
                    counts[j] = 1
        # those pointed at leave their groups, by how often they were
        moves: dict[int, list[int]] = {}
        for j, k in counts.items():
            key = k * n + of[j]
            if key in moves:
                moves[key].append(j)
            else:
                moves[key] = [j]
        # the fewest come to stand right behind the old group
        for key in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            moved, old = moves[key], key % n
            if alive[old] == len(moved):  # the whole group goes on: it keeps its place
                continue
            new = len(members)
            moved.sort()
            members.append(moved)
            alive.append(len(moved))
            done.append(False)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            alive[old] -= len(moved)
            for j in moved:
                of[j] = new
        g = below[g]
    g = 0
    while below[g] >= 0:
        g = below[g]
    slot, at = [0] * len(members), 0
    while g >= 0:
        slot[g] = at
        at += alive[g]
        g = above[g]
    out, placed = [-1] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        j = out[r] - 1
        while not placed[j]:  # -1 stands for the last symbol, which is placed
            placed[j] = True
            out[slot[of[j]]] = j
            slot[of[j]] += 1
            j = prev[j]
    return out
