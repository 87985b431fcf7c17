"""Routing into tables over restarts, raw calls, first set-up, and contexts from files."""

import datetime as dt
import json

import pytest

from notes_engine import schemas
from notes_engine.operators import context, gate
from notes_engine.sources import files, hooks
from notes_engine.streaming import fan_out
from test_context import REASONS, REQUESTS, docs, staged
from test_notes import DAY


def routed(tables):
    names = ("onboard", "remember", "recall", "checkpoint", fan_out.DEAD)
    return sorted(((r.request_id, name) for name in names for r in tables.table(name).collect()))


def test_requests_reach_one_table_once_over_a_restart(spark, tmp_path, monkeypatch):
    stream = staged(spark, spark.createDataFrame(REQUESTS, schemas.REQUESTS), tmp_path, ["request_id"])
    tables = fan_out.RoutedTables(spark, f"file://{tmp_path}/out")
    assert routed(tables) == []
    route, calls = fan_out.requests.by_tool, []

    def dies_once(judged):
        served, dead = route(judged)
        calls.append(1)
        if len(calls) == 2:  # in the second micro-batch, between two tables
            served["recall"] = None
        return served, dead

    with monkeypatch.context() as m:
        m.setattr(fan_out.requests, "by_tool", dies_once)
        with pytest.raises(Exception, match="NoneType"):
            tables.start(stream, availableNow=True).awaitTermination()
    first = routed(tables)
    assert 0 < len(first) < len(REQUESTS) and tables.commits.latest() == 1  # the batch that died isn't seen
    tables.start(stream, availableNow=True).awaitTermination()
    assert len(routed(tables)) == len(REQUESTS) == len({i for i, _ in routed(tables)})
    assert {r.request_id: r.reason for r in tables.table(fan_out.DEAD).collect()} == REASONS
    batch = spark.createDataFrame(REQUESTS[:2], schemas.REQUESTS)
    tables.write(batch, 0)  # a batch that is run again changes nothing
    assert routed(tables)[: len(first)] == first and tables.commits.latest() == 3


def test_checkpoint_requests_are_routed(spark, tmp_path):
    ask = lambda i, **a: (i, "checkpoint", json.dumps({"project_id": "p", **a}))
    rows = [ask(1, message="m"), ask(2, action="create", message=""), ask(3, action="list"), ask(4, action="rollback", checkpoint_id="c", dry_run=True), ask(5, action="reset"), ask(6, action="create", message="m", include_untracked=False), (7, "checkpoint", '{"action": "list"}')]
    tables = fan_out.RoutedTables(spark, f"file://{tmp_path}/out")
    tables.write(spark.createDataFrame(rows, schemas.REQUESTS), 0)
    got = {r.request_id: (r.action, r.message, r.checkpoint_id, r.include_untracked, r.dry_run) for r in tables.table("checkpoint").collect()}
    assert got == {1: ("create", "m", None, True, False), 3: ("list", None, None, True, False), 4: ("rollback", None, "c", True, True), 6: ("create", "m", None, False, False)}
    assert {r.request_id: r.reason for r in tables.table(fan_out.DEAD).collect()} == {2: "missing message", 5: "unknown action", 7: "missing project_id"}


def test_raw_calls(spark):
    call = lambda **a: json.dumps(a)
    lines = [call(tool_name="Edit", cwd="/w/p", tool_input={"file_path": "a.py"}), call(tool_name="onboard", cwd="/w/p/"), call(tool_name="Edit", cwd="/w/p", tool_input={"file_path": "a.py"}, more=[1]), '{"tool_name": "Edit", "cwd"', "", None, "[1]", '"x"', call(cwd="/w/p"), call(tool_name="Edit", cwd=None, tool_input=None), '{"tool_name": 5, "cwd": "/w/p"}']
    table = spark.createDataFrame([("s", DAY + dt.timedelta(minutes=k), k, x) for k, x in enumerate(lines)], "session_id string, ts timestamp_ntz, event_id long, line string")
    marked = spark.createDataFrame([("p",)], "project_id string")
    rows = gate.gate_events(hooks.parse_calls(table), marked).orderBy("event_id").collect()
    assert [r.decision for r in rows] == ["block", *["allow"] * 10] and [k for k, r in enumerate(rows) if r.reason == "malformed"] == [3, 4, 5, 6, 7]
    assert [r.tool_name for r in rows[8:]] == ["", "Edit", "5"] and rows[9].project_id is None
    assert sorted((r.event_id, r.line) for r in hooks.dead_calls(table).collect()) == [(k, lines[k]) for k in (3, 4, 5, 6, 7)]
    assert hooks.parse_calls(table.limit(0)).count() == 0


def test_initialising_adds_what_is_absent_and_nothing_else(spark):
    there = docs(spark, [("a/p", "map", "own"), ("a/p", "task", None), ("q", "settings", "{}")])
    projects = spark.createDataFrame([("a/p",), ("q",), ("new",), ("new",), (None,)], "project_id string")
    at = dt.datetime(2024, 5, 6, 7, 8, 9)
    added = context.initialise(projects, there, at, {"map": "M", "task": "T"})
    settings = lambda name: json.dumps({"project_name": name, "version": "4.0", "created_at": "2024-05-06T07:08:09"}, separators=(",", ":"))
    assert sorted(map(tuple, added.collect())) == [("a/p", "settings", settings("p")), ("new", "map", "M"), ("new", "settings", settings("new")), ("new", "task", "T"), ("q", "map", "M"), ("q", "task", "T")]
    assert context.initialise(projects, there.union(added), at, {"map": "M", "task": "T"}).count() == 0
    assert context.initialise(projects.limit(0), there, at).count() == 0


def test_contexts_from_files(spark, tmp_path):
    for project, kind, body in (("a", "map", "# My\nmap"), ("a", "decisions", "none"), ("a", "settings", '{"project_name": "A", "version": "7"}'), ("b", "task", "do"), ("b", "settings", "{cut")):
        (tmp_path / project / f"kind={kind}").mkdir(parents=True)
        (tmp_path / project / f"kind={kind}" / "part-0.txt").write_text(body)
    found = files.scan_docs(spark, f"{tmp_path}/*/*/*.txt", {k: k for k in ("map", "decisions", "task", "settings")})
    rows = context.contexts(found, settings=files.scan_settings(spark, f"{tmp_path}/*/kind=settings/*.txt")).orderBy("project_id").collect()
    assert [(r.project_name, r.version, r.initialised, r.map_found, r.decisions_found, r.task_found) for r in rows] == [("A", "7", True, True, True, False), ("b", "4.0", True, False, False, True)]
    assert rows[0].context == "# Project Map\n\n# My\nmap\n\n---\n\n# Decisions\n\nnone" and rows[1].context == "# Current Task\n\ndo"


def test_note_lines(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 2, 3, 4, 567_891)
    notes = spark.createDataFrame([("a", "k", 'v"\n\u00e9', ["t"], at, at, 3), ("b/c", None, None, None, None, None, 0), ("a", "k", "again", ["y", "x", "y"], None, at, 4)], schemas.NOTES)
    files.write_note_lines(notes, f"{tmp_path}/lines")
    cut = ['{"project_id":"q\\"r","key":"k","val', "nonsense", '{"key":"k","position":1}', '{"project_id":"z","key":"k"}', '{"project_id":"z","position":"many"}']
    spark.createDataFrame([(x,) for x in cut], "value string").coalesce(1).write.text(f"{tmp_path}/cut")
    found, rejects = files.scan_note_lines(spark, [f"{tmp_path}/lines", f"{tmp_path}/cut"])
    assert sorted(tuple(r) for r in found.orderBy("position").collect()) == sorted([("b/c", "", "", [], None, None, 0), ("a", "k", 'v"\n\u00e9', ["t"], at, at, 3), ("a", "k", "again", ["x", "y"], None, at, 4)])
    assert sorted(str(r.project_id) for r in rejects.collect()) == sorted(['q\\"r', "None", "None", "z", "z"])
    none, no_rejects = files.scan_note_lines(spark, f"{tmp_path}/lines")
    assert none.count() == 3 and no_rejects.count() == 0
