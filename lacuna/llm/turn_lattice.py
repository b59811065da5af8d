"""Cheapest repair of a run of turns: Dijkstra on the lattice of (turn index, grammar state).

States say what stands before: nothing, a system turn, a user turn, an assistant turn. Roles have to read
``(s?(ua)+)?``, so from a state each edit leads to one state only, and the letters of a path (D delete,
I insert, K keep, R rerole) fix it. Neighbours of a node are made when it is popped; the key is
(cost, letters), and the first popped accepting node of the last index has the cheapest edits, of equal
costs the ASCII-least. No letters of a path to a node begin those of another path of equal cost to it (more
letters at the same index are insertions, and those cost), so cheapest parts side by side are cheapest.
"""

from __future__ import annotations

import heapq
from itertools import groupby

# Costs of edits, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ACCEPTING = (START, ASSISTANT)
#: The state that a user or assistant turn leads to, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {USER: "u", ASSISTANT: "a"}

Best = tuple[int, str]


def search(turns: list[tuple[str, int]], start: int = START, ends: tuple[int, ...] = ACCEPTING, stop: bool = True) -> dict[int, Best]:
    """(cost, letters) by end state, from ``start`` over all turns (initial, fault); with ``stop`` that of the first popped one only."""
    heap, done, found, last = [(0, "", 0, start)], set(), {}, len(turns)
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == last and state in ends:
            found[state] = cost, letters
            if stop or len(found) == len(ends):
                return found
        push = lambda c, letter, j, s: (j, s) in done or heapq.heappush(heap, (cost + c, letters + letter, j, s))  # noqa: B023, E731
        push(INSERT, "I", i, NEXT[state])
        if i == last:
            continue
        initial, fault = turns[i]
        push(DELETE, "D", i + 1, state)
        if fault in (BLANK, DUPLICATE):
            continue
        more = TRUNCATED if fault == CUT else 0
        if initial == INITIAL[NEXT[state]]:
            push(KEEP + more, "K", i + 1, NEXT[state])
        elif initial == "s" and state == START:
            push(KEEP + more, "K", i + 1, SYSTEM)
        push(REROLE + more, "R", i + 1, NEXT[state])
    return found


def through(turns: list[tuple[str, int]]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) between all states that a run of turns can join; before a longer text's later part."""
    return [(a, b, *best) for a in STATES for b, best in sorted(search(turns, a, tuple(STATES), False).items())]


def follow(best: dict[int, Best], steps: list[tuple[int, int, int, str]]) -> dict[int, Best]:
    """The cheapest ways so far, carried on over one more run."""
    out: dict[int, Best] = {}
    for a, b, cost, letters in steps:
        if a in best:
            way = best[a][0] + cost, best[a][1] + letters
            out[b] = min(out.get(b, way), way)
    return out


def cheapest(best: dict[int, Best]) -> Best:
    return min(best[s] for s in ACCEPTING if s in best)


class Rewriter:
    """The repaired lines of a conversation from its letters, which its turns are given to in order."""

    def __init__(self, letters: str):
        self._letters, self._at, self._state = letters, 0, START

    def _inserted(self) -> list[str]:
        out = []
        while self._letters[self._at : self._at + 1] == "I":
            self._at += 1
            self._state = NEXT[self._state]
            out.append(f"{ROLES[self._state]}:")
        return out

    def feed(self, role: str, text: str) -> list[str]:
        out = self._inserted()
        letter = self._letters[self._at]
        self._at += 1
        if letter == "K":
            self._state = SYSTEM if role[:1] == "s" else NEXT[self._state]
            out.append(f"{role}:{text}")
        elif letter == "R":
            self._state = NEXT[self._state]
            out.append(f"{ROLES[self._state]}:{text}")
        return out

    def close(self) -> list[str]:
        return self._inserted()


def illegal(initials: str) -> int:
    """Neighbours whose initials are not su, ua or au. A turn without an initial stands as a space."""
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def runs(rows, key):
    """(key, iterator) of neighbouring rows."""
    return groupby(rows, key)
