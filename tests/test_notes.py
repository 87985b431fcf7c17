"""Note mutations and recall."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notes_engine import schemas
from notes_engine.operators import fold, recall

DAY = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """Events from (project, key, op, value, tags, minutes, seq)."""
    return spark.createDataFrame([(p, k, o, v, t, DAY + dt.timedelta(minutes=m), s) for p, k, o, v, t, m, s in rows], schemas.NOTE_EVENTS)


def store(spark, rows):
    """Notes from (project, key, value, tags, updated minutes or None), positions as given."""
    return spark.createDataFrame([(p, k, v, t, DAY, None if m is None else DAY + dt.timedelta(minutes=m), i) for i, (p, k, v, t, m) in enumerate(rows)], schemas.NOTES)


def replay(rows):
    """The notes and labels that applying events one by one gives."""
    notes, labels = {}, []
    for p, k, o, v, t, m, s in sorted(rows, key=lambda r: (r[5], r[6])):
        at, live = DAY + dt.timedelta(minutes=m), (p, k) in notes
        if o == "forget":
            labels.append((s, "deleted" if live else "not_found"))
            notes.pop((p, k), None)
        elif live:
            labels.append((s, "updated"))
            n = notes[p, k]
            n["value"] = n["value"] + "\n" + (v or "") if o == "append" else v or ""
            n["tags"] |= set(t or [])
            n["updated"] = at
        else:
            labels.append((s, "created"))
            notes[p, k] = {"value": v or "", "tags": set(t or []), "created": at, "updated": at, "position": s}
        labels[-1] += (sum(q == p for q, _ in notes),)
    return notes, labels


def check(spark, rows):
    notes, labels = replay(rows)
    got = {(r.project_id, r.key): r for r in fold.fold_notes(log(spark, rows)).collect()}
    assert set(got) == set(notes)
    for k, n in notes.items():
        r = got[k]
        assert (r.value, r.tags, r.created_at, r.updated_at, r.position) == (n["value"], sorted(n["tags"]), n["created"], n["updated"], n["position"])
    assert sorted((r.seq, r.action, r.total) for r in fold.note_actions(log(spark, rows)).collect()) == sorted(labels)


def numbered(events):
    return [(*e, i) for i, e in enumerate(events)]


def test_create_update_append(spark):
    check(spark, numbered([("p", "k", "replace", "original", ["test"], 0), ("p", "k", "replace", "updated", ["updated"], 1), ("p", "k", "append", "second", None, 2), ("p", "k", "append", "", [], 2), ("p", "j", "append", "first", ["b", "a", "b"], 3)]))


def test_forget_and_again(spark):
    check(spark, numbered([("p", "k", "forget", None, None, 0), ("p", "k", "replace", "x", ["a"], 1), ("p", "k", "append", "y", None, 2), ("p", "k", "forget", None, None, 3), ("p", "k", "forget", None, None, 4), ("p", "k", "append", "z", ["c"], 2000), ("p", "l", "replace", None, None, 9), ("p", "l", "forget", None, None, 4000)]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("kl"), st.sampled_from(["replace", "append", "forget"]), st.sampled_from(["", "a", "b c", None]), st.sampled_from([None, [], ["x"], ["y", "x"]]), st.integers(0, 4000)), max_size=25))
def test_fold_is_replay(spark, events):
    check(spark, numbered(events))


def test_dedup_and_forget(spark):
    notes = store(spark, [("p", "k", "1", None, 0), ("p", "k", "2", None, 0), ("p", "j", "3", None, 0), ("q", "k", "4", None, 0)])
    assert sorted(r.value for r in fold.dedup_first(notes).collect()) == ["1", "3", "4"]
    keys = spark.createDataFrame([("p", "k"), ("p", "k"), ("p", "none"), ("r", "k")], "project_id string, key string")
    assert sorted(r.value for r in fold.forget_notes(notes, keys).collect()) == ["3", "4"]
    assert sorted((r.project_id, r.key, r.deleted, r.remaining, r.error) for r in fold.forget_report(notes, keys).collect()) == [("p", "k", True, 1, None), ("p", "none", False, 1, "not found"), ("r", "k", False, 0, "not found")]


NOTES = [
    ("p", "auth-pattern", "JWT Authentication 100%", ["pattern"], 5), ("p", "api_pattern", "REST API design", ["gotcha"], 7), ("p", "mem3", "x", ["pattern", "gotcha"], 7),
    ("p", "old", "İstanbul ΑΣ", None, None), ("p", "none", None, [None], 1), ("q", "auth", "other", ["pattern"], 9),
]


@pytest.mark.parametrize(
    ("query", "tags", "found"),
    [
        ("auth", None, {"auth-pattern"}), ("AUTH", None, {"auth-pattern"}), ("%", None, {"auth-pattern"}), ("_", None, {"api_pattern"}), ("", [], {n[1] for n in NOTES[:5]}),
        (None, ["pattern"], {"auth-pattern", "mem3"}), (None, ["Pattern"], set()), ("x", ["gotcha"], {"mem3"}), ("i̇stanbul", None, {"old"}), ("nothing", None, set()),
    ],
)
def test_recall_filters(spark, query, tags, found):
    assert {r.key for r in recall.recall(store(spark, NOTES), "p", query=query, tags=tags).collect()} == found


def test_recall_order_and_limits(spark):
    notes = store(spark, NOTES)
    assert [r.key for r in recall.recall(notes, "p").collect()] == ["api_pattern", "mem3", "auth-pattern", "none", "old"]
    assert [r.key for r in recall.recall(notes, "p", limit=2.0).collect()] == ["api_pattern", "mem3"]
    assert recall.recall(notes, "p", limit=0).count() == 0
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError, match="limit"):
            recall.recall(notes, "p", limit=bad)
    assert [r.value for r in recall.recall_key(notes, "p", "mem3").collect()] == ["x"] and recall.recall_key(notes, "p", "MEM3").count() == 0
    ranks = {(r.project_id, r.key): r["rank"] for r in recall.recall_per_project(notes, limit=1).collect()}
    assert ranks == {("p", "api_pattern"): 1, ("q", "auth"): 1}
    assert {(r.project_id, r.hits, r.total, r.message) for r in recall.recall_counts(notes, query="auth", limit=1).collect()} == {("p", 1, 5, None), ("q", 1, 1, None)}


def test_requests_are_single_recalls(spark):
    notes = store(spark, NOTES)
    reqs = spark.createDataFrame([(1, "p", None, "auth", None, None), (2, "p", "mem3", "zzz", ["no"], 0), (3, "p", "zzz", None, None, None), (4, "x", None, None, None, None), (5, "p", "", "", [], 3), (6, "p", None, "zzz", None, None)], schemas.RECALL_REQUESTS)
    got = {}
    for r in recall.recall_batch(notes, reqs).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append(r.key)
    assert got == {1: ["auth-pattern"], 2: ["mem3"], 5: ["api_pattern", "mem3", "auth-pattern"]}
    replies = {r.request_id: (r.hits, r.total, r.message) for r in recall.recall_replies(notes, reqs).collect()}
    assert replies == {1: (1, 5, None), 2: (1, 5, None), 3: (0, 5, "no note with key zzz"), 4: (0, 0, "no notes stored"), 5: (3, 5, None), 6: (0, 5, "no match")}


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = recall.recall_per_project(store(spark, NOTES).where(F.col("key") != "x"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
