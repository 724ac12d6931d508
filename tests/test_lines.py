"""Line alignment against the plain quadratic table."""

import random

import pytest

from fleetbump.functions import lines


def longest(b, a):
    table = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i, x in enumerate(b):
        for j, y in enumerate(a):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnop"])
def test_matches_are_a_longest_common_subsequence_between_anchors(letters):
    rng = random.Random(len(letters))
    for _ in range(400):
        b = rng.choices(letters, k=rng.randint(0, 25))
        a = [x for x in b if rng.random() < 0.7] if rng.random() < 0.5 else rng.choices(letters, k=rng.randint(0, 25))
        for _ in range(rng.randint(0, 3)):
            a.insert(rng.randint(0, len(a)), rng.choice(letters))
        found = lines.matches(b, a)
        assert all(b[i] == a[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))
        # Without lines that are unique on both sides nothing but the longest will do.
        twice = [x for x in b for _ in "12"], [x for x in a for _ in "12"]
        assert len(lines.matches(*twice)) == longest(*twice)
        rebuilt, at = [], 0
        for b0, b1, a0, a1 in lines.hunks(b, a):
            rebuilt += b[at:b0] + a[a0:a1]
            at = b1
        assert rebuilt + b[at:] == a


def test_unique_lines_are_anchors():
    b, a = list("xAxBxCx"), list("xBxAxCxx")
    assert ("C", "C") in {(b[i], a[j]) for i, j in lines.matches(b, a)}
    many = [f"line {i}" for i in range(50_000)]
    assert lines.hunks(many, many[:100] + many[105:]) == [(100, 105, 100, 100)]
    assert lines.hunks(many, [*many[:7], "new", *many[7:]]) == [(7, 7, 7, 8)]


def test_equal_lines_give_the_earliest_place():
    assert lines.hunks(list("abbbc"), list("abc")) == [(1, 3, 1, 1)]
    assert lines.hunks(list("abc"), list("abbbc")) == [(1, 1, 1, 3)]
    assert lines.changes(["{", "// setup", "Old();", "Keep();", "// setup", "}"], ["{", "Keep();", "// setup", "}"]) == [
        (2, "// setup", ""),
        (3, "Old();", ""),
    ]


def test_changes():
    assert lines.changes([], []) == [] and lines.changes([""], [""]) == []
    assert lines.changes(list("abc"), list("aXc")) == [(2, "b", "X")]
    assert lines.changes(list("abc"), list("ac")) == [(2, "b", "")]
    assert lines.changes(list("ac"), list("abc")) == [(2, "", "b")]
    # As many lines as before, but not in the same places.
    assert lines.changes(list("abcd"), list("acdX")) == [(2, "b", ""), (4, "", "X")]
