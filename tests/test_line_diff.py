"""Ordered line differences against a table of all prefixes."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from notes_engine.operators import checkpoints, line_diff
from test_notes import store


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_matches_are_a_longest_common_subsequence(a, b):
    pairs = line_diff.matched(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(a, b)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_long_texts():
    rng = random.Random(1)
    a, b = ([rng.randrange(50) for _ in range(1500)] for _ in range(2))
    assert len(line_diff.matched(a, b)) == longest(a, b)
    c = list(range(60_000))
    assert len(line_diff.matched(c, c[1:] + c[:1])) == 59_999


def test_scripts_turn_the_old_text_into_the_new():
    rng = random.Random(4)
    for _ in range(200):
        old, new = ("\n".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2))
        script, kept = line_diff.edit_script(old, new), dict(enumerate(old.split("\n"), 1))
        for change, place, line in script:
            if change == line_diff.DELETED:
                assert kept.pop(place) == line
        lines = list(kept.values())
        for change, place, line in script:
            if change == line_diff.INSERTED:
                lines.insert(place - 1, line)
        assert "\n".join(lines) == new


def test_difference_of_tables(spark):
    old = store(spark, [("p", "moved", "a\nb\nc", None, 0), ("p", "same", "x", None, 0), ("p", "gone", "a\nb", None, 0), ("p", "null", None, None, 0), ("q", "moved", "", None, 0)])
    new = store(spark, [("p", "moved", "b\nc\na", None, 0), ("p", "same", "x", ["t"], 0), ("p", "new", "n\n", None, 0), ("p", "null", "", None, 0), ("q", "moved", "x", None, 0)])
    got = {(r.project_id, r.key, r.insertions, r.deletions) for r in line_diff.line_diff_stat(old, new).collect()}
    assert got == {("p", "moved", 1, 1), ("p", "gone", 0, 2), ("p", "new", 2, 0), ("q", "moved", 1, 1)}
    moved = {tuple(r)[2:] for r in line_diff.line_diff(old, new).where("project_id = 'p' AND key = 'moved'").collect()}
    assert moved == {("deleted", 1, "a"), ("inserted", 3, "a")}
    assert ("p", "moved") not in {(r.project_id, r.key) for r in checkpoints.diff_stat(old, new).collect()}  # as multisets they are the same
    assert line_diff.line_diff(old.limit(0), new.limit(0)).count() == 0
