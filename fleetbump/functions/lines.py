"""Alignment of two versions of a file, line by line; a small helper for tasks that compare pairs of texts."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter


def _anchors(b: list[str], a: list[str], b0: int, b1: int, a0: int, a1: int) -> list[tuple[int, int]]:
    """Lines that stand once in both ranges, as many as keep their order (a longest increasing run of places)."""
    in_b, in_a = Counter(b[b0:b1]), Counter(a[a0:a1])
    at = {line: i for i, line in enumerate(a[a0:a1], a0) if in_a[line] == 1}
    both = [(i, at[b[i]]) for i in range(b0, b1) if in_b[b[i]] == 1 and b[i] in at]
    ends: list[int] = []  # smallest last place of a run of each length, and the run's last pair
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(both):
        k = bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        if k == len(ends):
            ends.append(j)
            last.append(n)
        else:
            ends[k], last[k] = j, n
    run, n = [], last[-1] if last else -1
    while n >= 0:
        run.append(both[n])
        n = before[n]
    return run[::-1]


def _middle(b: list[str], a: list[str], b0: int, b1: int, a0: int, a1: int) -> tuple[int, int, int, int]:
    """A run of equal lines in the middle of a shortest edit of two ranges: (from and to in b, from and to in a).

    Paths are followed from both ends, furthest reach first (Myers 1986), so space grows with the edit only.
    """
    n, m = b1 - b0, a1 - a0
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            start = x
            while x < n and x - k < m and b[b0 + x] == a[a0 + x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and -d < delta - k < d and x + back[delta - k] >= n:
                return b0 + start, b0 + x, a0 + start - k, a0 + x - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            start = x
            while x < n and x - k < m and b[b1 - 1 - x] == a[a1 - 1 - x + k]:
                x += 1
            back[k] = x
            if not delta % 2 and -d <= delta - k <= d and x + ahead[delta - k] >= n:
                return b1 - x, b1 - start, a1 - x + k, a1 - start + k
    raise AssertionError("paths from both ends meet")


def matches(b: list[str], a: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in b, place in a) of lines that stay, in order.

    Common ends first; then lines that are unique on both sides; what lies between those by a longest common subsequence.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(b), 0, len(a), True)]
    while todo:
        b0, b1, a0, a1, anchored = todo.pop()
        while b0 < b1 and a0 < a1 and b[b0] == a[a0]:
            found.append((b0, a0))
            b0, a0 = b0 + 1, a0 + 1
        while b0 < b1 and a0 < a1 and b[b1 - 1] == a[a1 - 1]:
            b1, a1 = b1 - 1, a1 - 1
            found.append((b1, a1))
        if b0 == b1 or a0 == a1:
            continue
        anchors = _anchors(b, a, b0, b1, a0, a1) if anchored else []
        if not anchors:
            b_from, b_to, a_from, a_to = _middle(b, a, b0, b1, a0, a1)
            found += zip(range(b_from, b_to), range(a_from, a_to))
            todo += [(b0, b_from, a0, a_from, False), (b_to, b1, a_to, a1, False)]
            continue
        found += anchors
        for i, j in [*anchors, (b1, a1)]:
            todo.append((b0, i, a0, j, True))
            b0, a0 = i + 1, j + 1
    return sorted(found)


def hunks(b: list[str], a: list[str]) -> list[tuple[int, int, int, int]]:
    """Ranges (from and to in b, from and to in a) that differ.

    Where lines are only lost, or only won, and equal lines stand next to the range, it is moved to its earliest place.
    """
    out, b0, a0 = [], 0, 0
    for i, j in [*matches(b, a), (len(b), len(a))]:
        if i > b0 or j > a0:
            b_from, b_to, a_from, a_to = b0, i, a0, j
            floor = out[-1][1] if out else 0
            while a_from == a_to and b_from > floor and b[b_from - 1] == b[b_to - 1]:
                b_from, b_to, a_from, a_to = b_from - 1, b_to - 1, a_from - 1, a_to - 1
            floor = out[-1][3] if out else 0
            while b_from == b_to and a_from > floor and a[a_from - 1] == a[a_to - 1]:
                b_from, b_to, a_from, a_to = b_from - 1, b_to - 1, a_from - 1, a_to - 1
            out.append((b_from, b_to, a_from, a_to))
        b0, a0 = i + 1, j + 1
    return out


def changes(b: list[str], a: list[str]) -> list[tuple[int, str, str]]:
    """(line, original, replacement), lines counted from 1.

    In files of as many lines as before, lines of a range that keeps its length are replaced one by one. All other lost
    lines have no replacement and are counted in the old file; won lines have no original and are counted in the new one.
    """
    out = []
    for b0, b1, a0, a1 in hunks(b, a):
        if len(b) == len(a) and b1 - b0 == a1 - a0:
            out += [(b0 + 1 + i, x, y) for i, (x, y) in enumerate(zip(b[b0:b1], a[a0:a1]))]
        else:
            out += [(i, x, "") for i, x in enumerate(b[b0:b1], b0 + 1)]
            out += [(i, "", x) for i, x in enumerate(a[a0:a1], a0 + 1)]
    return out
