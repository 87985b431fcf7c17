"""Context assembly, checkpoints, the gate, sources and streams."""

import datetime as dt
import gc
import json
import random
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F

from notes_engine import schemas
from notes_engine.operators import checkpoints, context, gate
from notes_engine.sources import files, lines, requests
from notes_engine.streaming import processors
from notes_engine.streaming.runs import run_to_table
from test_notes import DAY, log, numbered, replay, store


def docs(spark, rows):
    return spark.createDataFrame(rows, schemas.CONTEXT_DOCS)


def test_registry_and_defaults(spark):
    d = docs(spark, [("p", "settings", "{}"), ("p", "map", "own"), ("q", "task", "t"), ("r", None, None)])
    assert {(r.project_id, r.initialised, r.error) for r in context.project_registry(d).collect()} == {("p", True, None), ("q", False, "not initialised"), ("r", False, "not initialised")}
    got = {(r.project_id, r.kind): (r.body, r.filled) for r in context.fill_defaults(d, {"map": "M", "task": "T"}).collect()}
    assert got == {("p", "map"): ("own", False), ("p", "task"): ("T", True), ("q", "map"): ("M", True), ("q", "task"): ("t", False), ("r", "map"): ("M", True), ("r", "task"): ("T", True)}


@pytest.mark.parametrize("n", [1, 10, 11])
def test_summary(spark, n):
    notes = store(spark, [("p", f"k{i}", "v", ["a", "b"] if i == 0 else None, 0) for i in range(n)])
    text = context.note_summary(notes).first().summary
    assert text.startswith(f"\n\n## Stored Memories ({n} total)\n- **k0** [a, b]\n")
    assert text.count("- **") == min(n, 10) and text.endswith("- ... and 1 more\n") == (n == 11)


def test_whole_context(spark):
    d = docs(spark, [("a/p", "task", "now"), ("a/p", "map", "# My Project"), ("a/p", "settings", "{}"), ("a/p", "decisions", ""), ("q", "map", "X" * 10_000), ("e", "map", "\U0001f600" * 600)])
    notes = store(spark, [("a/p", "test-memory", "v", ["test"], 0)])
    rows = {r.project_id: r for r in context.contexts(d, notes, spark.createDataFrame([("q", "Queue", "5")], "project_id string, project_name string, version string"), budget=500).collect()}
    p, q = rows["a/p"], rows["q"]
    assert p.context == "# Project Map\n\n# My Project\n\n---\n\n# Current Task\n\nnow\n\n---\n\n\n\n## Stored Memories (1 total)\n- **test-memory** [test]\n"
    assert (p.initialised, p.project_name, p.version, p.truncated, p.map_found, p.decisions_found, p.task_found, p.memories_found) == (True, "p", "4.0", False, True, False, True, True)
    assert (q.context_size, q.truncated, q.project_name, q.memories_found) == (537, True, "Queue", False)
    assert rows["e"].context.startswith("# Project Map\n\n\U0001f600") and rows["e"].context_size == 537


@pytest.mark.parametrize(("size", "cut"), [(500, False), (501, True)])
def test_budget_edge(spark, size, cut):
    parts = spark.createDataFrame([("p", 0, "a" * 100), ("p", 1, "b" * (size - 100 - 7)), ("p", 2, None)][:2], "project_id string, place int, section string")
    r = context.assemble(parts, 500).first()
    assert (r.truncated, r.context_size) == (cut, 537 if cut else 500)


def test_a_cut_in_any_place_is_that_of_the_whole_text(spark):
    told = ["abcd", "ef", "", "ghij"]
    parts = spark.createDataFrame([("p", k, t) for k, t in enumerate(told)], "project_id string, place int, section string")
    whole = context.BETWEEN.join(told)
    for budget in range(len(whole) + 2):
        cut = whole[:budget] + context.CUT_SUFFIX if len(whole) > budget else whole
        assert tuple(context.assemble(parts, budget).first()) == ("p", cut, len(cut), len(whole) > budget)


# checkpoints


def test_change_set_and_diff(spark):
    old = store(spark, [("p", "same", "x", None, 0), ("p", "gone", "a\nb", None, 0), ("p", "changed", "a\nb\na", ["t"], 0)])
    new = store(spark, [("p", "same", "x", None, 9), ("p", "new", "n", None, 0), ("p", "changed", "b\na\nc", ["t"], 0)])
    assert {(r.key, r.status) for r in checkpoints.change_set(old, new).collect()} == {("gone", "D"), ("new", "A"), ("changed", "M")}
    assert {r.key for r in checkpoints.change_set(old, new, tracked_only=True).collect()} == {"gone", "changed"}
    assert checkpoints.change_set(old, old).count() == 0
    assert {(r.key, r.insertions, r.deletions) for r in checkpoints.diff_stat(old, new).collect()} == {("gone", 0, 2), ("new", 1, 0), ("changed", 1, 1)}


def test_store_round_trip(spark, tmp_path):
    kept = checkpoints.CheckpointStore(spark, f"file://{tmp_path}/s")
    v1 = store(spark, [("p", "k", "initial", ["t"], 0), ("q", "k", "other", None, 0)])
    v2 = store(spark, [("p", "k", "modified", ["t"], 1), ("p", "l", "new", None, 1), ("q", "k", "other", None, 0)])
    with pytest.raises(ValueError, match="message"):
        kept.create(v1, "")
    assert {(r.project_id, r.n_changes) for r in kept.create(v1, "dry", dry_run=True).collect()} == {("p", 1), ("q", 1)}
    assert kept.list().count() == 0
    with pytest.raises(LookupError, match="no checkpoints"):
        kept.restore(v1, "p")
    kept.create(v1, "CP1")
    first = {r.project_id: r.checkpoint_id for r in kept.heads().collect()}
    report = {r.project_id: (r.n_changes, r.error) for r in kept.create(v2, "CP2", dry_run=True).collect()}
    assert report == {"p": (2, None), "q": (None, "no changes")}
    kept.create(v2, "CP2")
    assert [(r.place, r.message) for r in kept.list().where("project_id = 'p'").orderBy("place").collect()] == [(1, "CP2"), (2, "CP1")]
    assert {(r.key, r.insertions) for r in kept.restore(v2, "p", first["p"], dry_run=True).collect()} == {("k", 1), ("l", 1)}
    dirty = v2.withColumn("value", F.concat("value", F.lit("!")))
    with pytest.raises(RuntimeError, match="changes"):
        kept.restore(dirty, "p", first["p"])
    with pytest.raises(LookupError, match="not found"):
        kept.restore(v2, "p", "nonsense")
    back = kept.restore(v2, "p", first["p"])
    assert sorted((r.project_id, r.key, r.value) for r in back.collect()) == [("p", "k", "initial"), ("q", "k", "other")]
    assert [(r.place, r.message) for r in kept.list().where("project_id = 'p'").collect()] == [(1, "CP1")]
    assert checkpoints.change_set(kept.head_notes(), back).count() == 0
    second = kept.manifest().where("project_id = 'p' AND seq = 2").first().checkpoint_id  # left behind, but not lost
    assert {r.value for r in kept.restore(back, "p", second).where("project_id = 'p'").collect()} == {"modified", "new"}


def test_create_moves_only_heads_of_changed_projects(spark, tmp_path):
    schema = "project_id string, key string, value string, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, position long"
    notes = lambda **values: spark.createDataFrame([("p", k, v, [], None, None, 0) for k, v in values.items()], schema)
    kept = checkpoints.CheckpointStore(spark, f"file://{tmp_path}/s")
    one = kept.create(notes(a="1"), "one").first()
    assert (one.n_changes, one.error, [tuple(x) for x in one.preview]) == (1, None, [("a", "A")])
    two = kept.create(notes(**{f"k{n:02}": "x" for n in range(12)}), "two").first()
    assert two.n_changes == 13 and [x.key for x in two.preview] == ["a", *(f"k{n:02}" for n in range(9))]
    now = kept.restore(kept.head_notes(), "p", one.checkpoint_id)
    again = kept.create(now, "two").first()  # nothing changed since "one"
    assert (again.checkpoint_id, again.error) == (None, "no changes")
    assert kept.heads().first().checkpoint_id == one.checkpoint_id and kept.manifest().count() == 2


def test_list_leaves_out_unmarked(spark):
    m = checkpoints.MARKER
    rows = [("p", str(i), str(i - 1) if i else None, f"{m}cp {m}{i}" if i % 2 else "Another change") for i in range(60)]
    manifest = spark.createDataFrame(rows, "project_id string, checkpoint_id string, parent_id string, message string")
    heads = spark.createDataFrame([("p", "58")], "project_id string, checkpoint_id string")
    got = checkpoints.list_checkpoints(manifest, heads).orderBy("place").collect()
    assert [r.checkpoint_id for r in got] == [str(i) for i in range(57, 17, -2)] and got[0].message == f"cp {m}57"


def test_list_walks_without_limits(spark):
    """Longer walks than any limit on recursive queries, and cycles."""
    m, limit = checkpoints.MARKER, "spark.sql.cteRecursionRowLimit"
    schema = "project_id string, checkpoint_id string, parent_id string, message string"
    rows = [("p", str(i), str(i - 1) if i else None, f"{m}{i}" if i in (0, 7, 1490) else "Another change") for i in range(1500)]
    manifest = spark.createDataFrame([*rows, ("q", "a", "gone", f"{m}a"), ("r", "a", None, "Another change")], schema)
    heads = spark.createDataFrame([("p", "1499"), ("q", "a"), ("r", "a"), ("s", "a")], "project_id string, checkpoint_id string")
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        got = checkpoints.list_checkpoints(manifest, heads).collect()
        newest = checkpoints.list_checkpoints(manifest, heads, listed=2).collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted((r.project_id, r.place, r.checkpoint_id, r.message) for r in got) == [("p", 1, "1490", "1490"), ("p", 2, "7", "7"), ("p", 3, "0", "0"), ("q", 1, "a", "a")]
    assert sorted((r.project_id, r.place, r.checkpoint_id) for r in newest) == [("p", 1, "1490"), ("p", 2, "7"), ("q", 1, "a")]
    ring = spark.createDataFrame([("p", "a", "b", "x"), ("p", "b", "a", "y")], schema)
    with pytest.raises(ValueError, match="cycle"):
        checkpoints.list_checkpoints(ring, heads.where("project_id = 'p'").withColumn("checkpoint_id", F.lit("a"))).collect()


# gate


def tool_events(spark, rows):
    return spark.createDataFrame([(s, p, t, f, DAY + dt.timedelta(minutes=m), i) for i, (s, p, t, f, m) in enumerate(rows)], schemas.TOOL_EVENTS)


EVENTS = [
    ("s", "p", "Edit", "a.py", 0), ("s", "p", "onboard", None, 1), ("s", "p", "Write", "a.py", 1439), ("s", "p", "Write", "a.py", 1441), ("s", "p", "Edit", "x/.claude/map.md", 1442),
    ("s", "p", "Edit", "x\\.claude\\map.md", 1443), ("s", "u", "Edit", "a", 1444), ("s", "p", None, None, 1445), ("t", "u", "onboard", None, 0), ("t", "p", "Edit", None, 5), ("s", "q", "Edit", "a", 2), ("s", "p", "Read", "a", 1446),
]
DECISIONS = ["block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "allow"]


def test_gate(spark):
    marked = gate.marked_projects(docs(spark, [("p", "settings", "{}"), ("q", "map", "m"), ("u", "task", "t"), ("p", "map", "m")]))
    rows = gate.gate_events(tool_events(spark, EVENTS), marked).orderBy("event_id").collect()
    assert [r.decision for r in rows] == DECISIONS and rows[7].reason == "malformed" and rows[0].reason == "onboard first"
    assert [r.decision for r in gate.gate_events(tool_events(spark, EVENTS), marked, per_project=True).orderBy("event_id").collect()][10] == "block"


def staged(spark, df, tmp_path, order):
    """A stream of df in one file and micro-batch for each third of its rows, in order."""
    rows = sorted(df.collect(), key=lambda r: tuple(r[c] for c in order))
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")


def test_gate_stream(spark, tmp_path):
    marked = gate.marked_projects(docs(spark, [("p", "settings", "{}"), ("q", "map", "m")]))
    stream = staged(spark, tool_events(spark, EVENTS), tmp_path, ["ts", "event_id"])
    rows = run_to_table(processors.gate_stream(stream, marked), "append", "gate").orderBy("event_id").collect()
    assert [r.decision for r in rows] == DECISIONS and len({r.batch_id for r in rows}) == 3


def test_fold_stream(spark, tmp_path):
    events = numbered([("p", "k", "replace", "a", ["x"], 0), ("p", "k", "append", "b", None, 1), ("p", "l", "append", "c", ["y"], 2), ("p", "k", "forget", None, None, 3), ("p", "l", "replace", "d", None, 4), ("p", "k", "append", "e", ["z"], 5), ("p", "l", "append", None, [], 6), ("q", "k", "forget", None, None, 7), ("p", "m", "replace", "f", None, 8)])
    stream = staged(spark, log(spark, events), tmp_path, ["ts", "seq"])
    rows = run_to_table(processors.fold_stream(stream), "update", "fold")
    last = rows.groupBy("project_id", "key").agg(F.max_by(F.struct("value", "tags", "live", "late"), "batch_id").alias("n")).select("project_id", "key", "n.*").where("live").collect()
    notes, _ = replay(events)
    assert {(r.project_id, r.key): (r.value, set(r.tags)) for r in last} == {k: (n["value"], n["tags"]) for k, n in notes.items()}
    assert all(r.late == 0 for r in last)


def test_a_bucket_of_keys_keeps_each_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(processors, "BUCKETS", 2)
    rng = random.Random(9)
    names = [("p", None), (None, "k"), *((p, k) for p in "pq" for k in "abcdefg")]
    events = numbered([(*rng.choice(names), rng.choice(["append", "append", "replace", "forget"]), f"v{i}", [rng.choice("xyz")], i // 2) for i in range(300)])
    stream = staged(spark, log(spark, events), tmp_path, ["ts", "seq"])
    rows = run_to_table(processors.fold_stream(stream), "update", "fold").collect()
    last = {(r.project_id, r.key): r for r in sorted(rows, key=lambda r: r.batch_id)}
    notes, _ = replay(events)
    assert {k: (r.value, set(r.tags), r.created_at, r.updated_at, r.position) for k, r in last.items() if r.live} == {k: (n["value"], n["tags"], n["created"], n["updated"], n["position"]) for k, n in notes.items()}
    assert len(rows) == len({(r.project_id, r.key, r.batch_id) for r in rows}) and last.keys() == set(names)


class Held:
    """A handle with one state value in memory."""

    def __init__(self, value=None):
        self.value = value

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def in_chunks(rows, columns, size, alive):
    """Frames of rows in a random order; alive: how many of them are held each time one more is asked for."""
    frames, rows = weakref.WeakSet(), random.Random(5).sample(rows, len(rows))
    for k in range(0, len(rows), size):
        chunk = pd.DataFrame(rows[k : k + size], columns=columns)
        frames.add(owner := Owner())
        chunk.attrs["owner"] = owner
        yield chunk
        del chunk, owner
        gc.collect()
        alive.append(len(frames))


class Owner:
    """Lives as long as its frame."""

    def __deepcopy__(self, memo):
        return Owner()


def test_stream_keys_are_never_whole_in_memory():
    """One key with all events: many chunks without order, of which a few are held at a time, give what replaying does."""
    rng, ops = random.Random(3), {"replace": 1, "append": 20, "forget": 1}
    state, batches, late = Held(), [], 0
    for batch in range(3):
        events = [("p", "k", op, f"{batch}.{i}", [rng.choice("abc")], 400 * batch + i // 2, 400 * batch + i) for i, op in enumerate(rng.choices([*ops], ops.values(), k=400))]
        batches += events
        if batch == 2:
            late = [("p", "k", "forget", None, None, 1, s) for s in range(7)]
            events = events + late
        alive, fold = [], processors.NoteFold()
        fold.init(state)
        rows = [(p, k, o, v, t, pd.Timestamp(DAY + dt.timedelta(minutes=m)), s) for p, k, o, v, t, m, s in events]
        (out,) = fold.handleInputRows(("p", "k"), in_chunks(rows, ["project_id", "key", "op", "value", "tags", "ts", "seq"], 10, alive), None)
        notes, _ = replay(batches)
        n, r = notes.get(("p", "k")), out.iloc[0]
        assert r.live == (n is not None) and max(alive) <= 3
        if n:
            assert (r.value, set(r.tags), r.created_at, r.updated_at, r.position) == (n["value"], n["tags"], n["created"], n["updated"], n["position"])
    assert r.late == len(late)

    rows = [("s", "p", rng.choice(["Edit"] * 99 + ["onboard"]), None, pd.Timestamp(DAY + dt.timedelta(minutes=10 * i)), i, True) for i in range(900)]
    want, last = {}, DAY.date()
    for r in rows:
        last = r[4].date() if r[2] == "onboard" else last
        want[r[5]] = last == r[4].date()
    assert len(set(want.values())) == 2
    alive, gates = [], processors.OnboardedDay("onboard")
    gates.init(state := Held((DAY.date(),)))
    got = {}
    for chunk in gates.handleInputRows(("s",), in_chunks(rows, ["session_id", "project_id", "tool_name", "file_path", "ts", "event_id", "marked"], 10, alive), None):
        assert len(chunk) <= 10
        got |= dict(zip(chunk["event_id"], chunk["onboarded"], strict=True))
    assert got == want and state.value == (last,) and max(alive) <= 3


# sources


def test_scans(spark, tmp_path):
    bodies = {
        "a": json.dumps([{"key": "k", "value": "v", "tags": ["b", "a", "b"], "created_at": "2024-01-01T00:00:00", "updated_at": "2024-01-01T00:00:01.5", "more": 1}, {"key": None, "value": None}]),
        "b": "[]", "c": "{not json", "d": " ", "e": '{"key": "k"}',
    }
    for name, body in bodies.items():
        (tmp_path / name / ".store").mkdir(parents=True)
        (tmp_path / name / ".store" / "notes.json").write_text(body)
        (tmp_path / name / ".store" / "map.md").write_text(f"map of {name}")
        (tmp_path / name / ".store" / "settings.json").write_text('{"project_name": "A"}' if name == "a" else body)
    notes, rejects = files.scan_notes(spark, f"{tmp_path}/*/.store/notes.json")
    rows = notes.orderBy("position").collect()
    assert [(r.project_id, r.key, r.value, r.tags, r.position) for r in rows] == [("a", "k", "v", ["a", "b"], 0), ("a", "", "", [], 1)]
    assert rows[0].updated_at == dt.datetime(2024, 1, 1, 0, 0, 1, 500_000)
    assert {r.project_id for r in rejects.collect()} == {"c", "d", "e"}
    found = files.scan_docs(spark, f"{tmp_path}/*/.store/*", {"map.md": "map"})
    assert {(r.project_id, r.kind, r.body) for r in found.collect()} == {(n, "map", f"map of {n}") for n in bodies}
    settings = {r.project_id: (r.project_name, r.version) for r in files.scan_settings(spark, f"{tmp_path}/*/.store/settings.json").collect()}
    assert settings["a"] == ("A", "4.0") and settings["c"] == ("c", "4.0")
    folder = files.write_notes(notes, f"{tmp_path}/table", 1)
    assert spark.read.parquet(folder).count() == 2
    with pytest.raises(Exception, match="already exists"):
        files.write_notes(notes, f"{tmp_path}/table", 1)


def test_stores_of_bounded_size(spark, tmp_path):
    """A project of many stores is scanned like one of a single store."""
    rows = [(p, f"{p}{i}", f"{i} \u00e9" * 20, ["t"], DAY, DAY, 10 * i) for p in ("one", "two") for i in range(120)] + [("small", "k", None, None, None, None, 5)]
    notes = spark.createDataFrame(rows, schemas.NOTES).repartition(7)
    files.write_stores(notes, f"{tmp_path}/stores", most=1000)
    stores = list(tmp_path.glob("stores/*/*/*.txt"))
    assert len({p.parent for p in stores if "=one" in str(p)}) > 5 and len({p.parent for p in stores}) == len(stores)
    assert max(p.stat().st_size for p in stores) < 1500
    found, rejects = files.scan_notes(spark, f"{tmp_path}/stores/*/*/*.txt")
    want = [(f"project_id={p}", f"{p}{i}", f"{i} \u00e9" * 20, i) for p in ("one", "two") for i in range(120)] + [("project_id=small", "k", "", 0)]
    assert sorted((r.project_id, r.key, r.value, r.position) for r in found.collect()) == sorted(want) and rejects.count() == 0
    for first, keys in ((0, "ab"), (2, "c")):
        (tmp_path / "p" / ".store" / f"from={first}").mkdir(parents=True)
        (tmp_path / "p" / ".store" / f"from={first}" / "notes.json").write_text(json.dumps([{"key": k} for k in keys]))
    found, _ = files.scan_notes(spark, f"{tmp_path}/p/.store/*/notes.json")
    assert sorted((r.project_id, r.key, r.position) for r in found.collect()) == [("p", "a", 0), ("p", "b", 1), ("p", "c", 2)]


def test_lines(spark):
    status = spark.createDataFrame([("p", " M f.txt"), ("p", "?? a b.md"), ("p", ""), ("p", "D  x")], "project_id string, line string")
    assert [(r.status, r.file) for r in lines.parse_status(status).collect()] == [("M", "f.txt"), ("??", "a b.md"), ("D", "x")]
    m = checkpoints.MARKER
    logs = spark.createDataFrame([("p", f"abc {m}first {m}x"), ("p", "def Another change"), ("p", "ghi")], "project_id string, line string")
    assert [(r.checkpoint_id, r.message, r.marked) for r in lines.parse_log(logs).collect()] == [("abc", f"first {m}x", True), ("def", "Another change", False), ("ghi", "", False)]


REQUESTS = [
    (1, "recall", '{"project_id": "p", "limit": 10.0}'), (2, "recall", '{"project_id": "p", "limit": -1}'), (3, "recall", '{"project_id": "p", "limit": 1.5}'), (4, "remember", '{"project_id": "p", "key": "k"}'),
    (5, "remember", '{"project_id": "p", "key": "k", "value": "v", "tags": ["t"]}'), (6, "nope", "{}"), (7, "recall", "{bad"), (8, "checkpoint", '{"project_id": "p"}'), (9, "checkpoint", '{"project_id": "p", "action": "list"}'),
    (10, "checkpoint", '{"project_id": "p", "action": "drop"}'), (11, "onboard", '{"project_id": "p"}'), (12, None, None), (13, "onboard", None),
]
REASONS = {2: "bad limit", 3: "bad limit", 4: "missing value", 6: "unknown tool", 7: "unreadable arguments", 8: "missing message", 10: "unknown action", 12: "unknown tool", 13: "unreadable arguments"}


def test_route(spark):
    served, dead = requests.route(spark.createDataFrame(REQUESTS, schemas.REQUESTS))
    assert {r.request_id: r.reason for r in dead.collect()} == REASONS
    assert [(r.request_id, r.project_id, r.limit) for r in served["recall"].collect()] == [(1, "p", 10)]
    assert [(r.key, r.value, r.tags, r.append) for r in served["remember"].collect()] == [("k", "v", ["t"], False)]
    assert [(r.action, r.include_untracked, r.dry_run) for r in served["checkpoint"].collect()] == [("list", True, False)]
    assert [(r.max_context_chars, r.include_notes_summary) for r in served["onboard"].collect()] == [(50_000, True)]


def test_route_stream(spark, tmp_path):
    stream = staged(spark, spark.createDataFrame(REQUESTS, schemas.REQUESTS), tmp_path, ["request_id"])
    assert {r.request_id: r.reason for r in run_to_table(requests.route(stream)[1], "append", "dead").collect()} == REASONS
