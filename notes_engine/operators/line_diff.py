"""Ordered line differences: a shortest script of deleted and inserted lines for each changed note, so that a line that moves counts as one of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notes_engine.operators.checkpoints import KEYS

DELETED, INSERTED = "deleted", "inserted"


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """By j from 0: the length of the longest common subsequence of a and b[:j].

    A row of the usual table is one integer of len(b) bits, a bit being 0 where
    the row grows; a line of a takes four operations on it.
    """
    places: dict[int, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for line in a:
        here = row & places.get(line, 0)
        row = (row + here | row - here) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def matched(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The places (i, j) of a longest common subsequence, ascending.

    What both begin and end with is matched first. The rest of a is halved, b is
    cut where the two halves' subsequences are longest together, and the parts
    are worked on alike: memory in proportion to the lines, time to
    len(a) * len(b) / 64.
    """
    out, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        i, m, j, n = parts.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if m - i == 1:
            if a[i] in b[j:n]:
                out.append((i, b.index(a[i], j, n)))
            continue
        middle = (i + m) // 2
        ahead = _prefix_lengths(a[i:middle], b[j:n])
        behind = _prefix_lengths(a[middle:m][::-1], b[j:n][::-1])[::-1]
        cut = j + int(np.argmax(ahead + behind))
        parts += [(i, middle, j, cut), (middle, m, cut, n)]
    return sorted(out)


def edit_script(was: str | None, now: str | None) -> list[tuple[str, int, str]]:
    """(deleted or inserted, place in the old or the new lines from 1, line), deletions first. A text that isn't there has no lines."""
    old, new = ([] if t is None else t.split("\n") for t in (was, now))
    numbers: dict[str, int] = {}
    a, b = ([numbers.setdefault(line, len(numbers)) for line in lines] for lines in (old, new))
    kept = matched(a, b)
    ours, theirs = {i for i, _ in kept}, {j for _, j in kept}
    return [(DELETED, i + 1, x) for i, x in enumerate(old) if i not in ours] + [(INSERTED, j + 1, x) for j, x in enumerate(new) if j not in theirs]


def _changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, key, was, now) of keys whose text differs; null where the note isn't there."""
    side = lambda df, name: df.select(*KEYS, F.coalesce("value", F.lit("")).alias(name))
    return side(old, "was").join(side(new, "now"), KEYS, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, key, change, place, line): the deleted and inserted lines of each changed note, as few as can be.

    Keys are unique on each side. A null text is empty, and an empty text is one
    empty line; a note that is not there has no lines, so a new note inserts all of its
    own. Both texts of a key meet in one join; a note's lines are compared in
    one task, with memory in proportion to them. Empty tables: no rows.
    """
    return _scripts(old, new).select(*KEYS, F.explode("script").alias("s")).select(*KEYS, "s.*")


def line_diff_stat(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, key, insertions, deletions) of keys whose lines differ: how many of each the shortest script has."""
    kinds = F.transform("script", lambda s: s["change"])
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long")
    return _scripts(old, new).select(*KEYS, count(INSERTED).alias("insertions"), count(DELETED).alias("deletions"))


def _scripts(old: DataFrame, new: DataFrame) -> DataFrame:
    @F.arrow_udf("array<struct<change:string,place:long,line:string>>")
    def script(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("change", pa.string()), ("place", pa.int64()), ("line", pa.string())]))
        for was, now in batches:
            rows = [[{"change": c, "place": k, "line": x} for c, k, x in edit_script(a, b)] for a, b in zip(was.to_pylist(), now.to_pylist(), strict=True)]
            yield pa.array(rows, kind)

    return _changed(old, new).select(*KEYS, script("was", "now").alias("script"))
