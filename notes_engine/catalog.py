"""The registered queries of the note operators over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt
import string
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.operators import checkpoints, context, fold, gate, line_diff, recall
from notes_engine.operators.checkpoints import MARKER
from notes_engine.operators.recall_many import recall_many as recall_many_requests
from notes_engine.plans import adapters
from notes_engine.sources import files, hooks, lines, requests
from notes_engine.streaming import event_time, fan_out, processors
from notes_engine.streaming.runs import ARRIVALS, arrivals, run_to_table, shared_dir

#: Literals that the recall queries look for.
PROJECT, KEY, QUERY, TAGS = "src3", "23", "TION", ("de", "fr")
BUDGET = 500
Query = Callable[[SparkSession, str], DataFrame]


def _time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def _tags(name: str = "tags"):
    return F.array_join(name, ",").alias(name)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return adapters.notes(adapters.read(spark, d, "documents"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return adapters.note_events(adapters.read(spark, d, "events"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = adapters.read(spark, d, "documents")
    return adapters.old_notes(docs), adapters.new_notes(docs)


def _requests(spark: SparkSession) -> DataFrame:
    rows = [(1, "src1", None, "tion", None, 5), (2, "src1", None, None, ["de"], None), (3, "src2", "22", "ignored", None, 3), (4, "src2", "nokey", None, None, None), (5, "nowhere", None, "x", None, None), (6, "src0", "", "", [], 4), (7, "src4", None, "%", None, None)]
    return spark.createDataFrame(rows, "request_id long, project_id string, key string, query string, tags array<string>, max_rows int")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Folds the event log and recalls each project's ten most recent notes with a match."""
    top = recall.recall_per_project(fold.fold_notes(_log(spark, d)), query="1", limit=10)
    return top.select("project_id", "rank", "key", "value", _tags(), _time("updated_at"))


def note_fold(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold_notes(_log(spark, d)).select("project_id", "key", "value", _tags(), _time("created_at"), _time("updated_at"), "position")


def note_actions(spark: SparkSession, d: str) -> DataFrame:
    return fold.note_actions(_log(spark, d)).select("project_id", "key", "seq", "action", _tags(), "total")


def note_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    by_text = _notes(spark, d).withColumn("key", F.md5("value"))
    return fold.dedup_first(by_text).select("project_id", "key", "position")


def _to_forget(spark: SparkSession, d: str) -> DataFrame:
    """Keys of German documents, and as many that don't exist."""
    german = adapters.read(spark, d, "documents").where(F.col("lang") == "de").select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("key"))
    return german.unionByName(german.withColumn("key", F.concat(F.lit("x"), "key")))


def forget_batch(spark: SparkSession, d: str) -> DataFrame:
    return fold.forget_notes(_notes(spark, d), _to_forget(spark, d)).select("project_id", "key", "position")


def forget_report(spark: SparkSession, d: str) -> DataFrame:
    return fold.forget_report(_notes(spark, d), _to_forget(spark, d))


def recall_key(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_key(_notes(spark, d), PROJECT, KEY).select("project_id", "key", "value", _time("updated_at"))


def recall_query(spark: SparkSession, d: str) -> DataFrame:
    return recall.search(_notes(spark, d), query=QUERY).select("project_id", "key", _tags())


def recall_tags(spark: SparkSession, d: str) -> DataFrame:
    return recall.search(_notes(spark, d), tags=TAGS).select("project_id", "key", _tags())


def recall_combined(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall(_notes(spark, d), PROJECT, query=QUERY, tags=("en", "fr")).select("project_id", "key", _time("updated_at"))


def recall_topk_per_project(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_per_project(_notes(spark, d), query=QUERY, tags=("en", "fr")).select("project_id", "key", F.col("rank").cast("long").alias("rank"))


def recall_counts(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_counts(_notes(spark, d), query=QUERY, tags=TAGS)


def recall_batch(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_batch(_notes(spark, d), _requests(spark)).select("request_id", "project_id", "key", F.col("rank").cast("long").alias("rank"))


def recall_replies(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall_replies(_notes(spark, d), _requests(spark))


def recall_many(spark: SparkSession, d: str) -> DataFrame:
    """A request of each document against the notes of its source."""
    found = recall_many_requests(_notes(spark, d), adapters.document_requests(adapters.read(spark, d, "documents")))
    return found.select("request_id", F.col("rank").cast("long").alias("rank"), "project_id", "key", F.md5("value").alias("value_md5"))


def project_registry(spark: SparkSession, d: str) -> DataFrame:
    return context.project_registry(adapters.conversation_docs(adapters.read(spark, d, "conversations")))


def default_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = adapters.conversation_docs(adapters.read(spark, d, "conversations"))
    one = docs.groupBy("project_id", "kind").agg(F.min("body").alias("body"))
    return context.fill_defaults(one).select("project_id", "kind", F.md5("body").alias("body_md5"), "filled")


def note_summary(spark: SparkSession, d: str) -> DataFrame:
    return context.note_summary(_notes(spark, d))


def context_assemble(spark: SparkSession, d: str) -> DataFrame:
    parts = adapters.conversation_sections(adapters.read(spark, d, "conversations"))
    return context.assemble(parts, BUDGET)


def context_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whole contexts from conversations as documents, one of each kind, and from note summaries of the sources."""
    docs = adapters.conversation_docs(adapters.read(spark, d, "conversations"))
    one = docs.groupBy("project_id", "kind").agg(F.min("body").alias("body"))
    return context.contexts(one, _notes(spark, d), budget=BUDGET).drop("context")


def change_set(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.change_set(*_versions(spark, d))


def change_set_tracked(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.change_set(*_versions(spark, d), tracked_only=True)


def diff_stat(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.diff_stat(*_versions(spark, d))


def line_diff_stat(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a version with the first line moved to the end, one more line, or neither."""
    docs = adapters.read(spark, d, "documents").where("text IS NOT NULL")
    lines = F.split("text", "\n", -1)
    moved = F.array_join(F.concat(F.slice(lines, 2, F.size(lines)), F.slice(lines, 1, 1)), "\n")
    text = F.when(F.col("lang") == "en", moved).when(F.col("lang") == "fr", F.concat("text", F.lit("\nextra"))).otherwise(F.col("text"))
    return line_diff.line_diff_stat(adapters.notes(docs), adapters.notes(docs.withColumn("text", text)))


def checkpoint_list(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.manifest(adapters.read(spark, d, "orders"))
    return checkpoints.list_checkpoints(rows, adapters.heads(rows))


def checkpoint_targets(spark: SparkSession, d: str) -> DataFrame:
    """For customers in one segment the last checkpoint, for others one that may be another customer's."""
    rows = adapters.manifest(adapters.read(spark, d, "orders"))
    wanted = adapters.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("project_id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey").cast("string")).alias("checkpoint_id"))
    return checkpoints.resolve_targets(rows, adapters.heads(rows), wanted)


def restore_state(spark: SparkSession, d: str) -> DataFrame:
    """Restores all sources to the first version; of the two that are asked for, one has changes that no checkpoint holds."""
    old, new = _versions(spark, d)
    current = new.where(F.col("project_id") != "src1").unionByName(new.where(F.col("project_id") == "src1").withColumn("value", F.concat("value", F.lit("!"))))
    targets = new.select("project_id").distinct().withColumn("checkpoint_id", F.lit("c1"))
    out = checkpoints.restored(current, old.withColumn("checkpoint_id", F.lit("c1")), targets, new)
    return out.select("project_id", "key", F.md5("value").alias("value_md5"))


def _cycle(spark: SparkSession, d: str):
    """A store after two checkpoints of all sources, the first one's report and the second's, and the notes now: one source has changes that no checkpoint holds."""
    old, new = _versions(spark, d)
    store = checkpoints.CheckpointStore(spark, f"{shared_dir(spark)}/cycle-{uuid.uuid4().hex}")
    reports = store.create(old, "first"), store.create(new, "second")
    current = new.withColumn("value", F.when(F.col("project_id") == "src1", F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return store, reports, current


def checkpoint_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Create, change, create, restore to the first checkpoint, list: the reports, the list, and the notes at the end."""
    store, reports, current = _cycle(spark, d)
    first = store.at(1).heads()
    notes, restored = store.restore_all(current, first)
    told = lambda df, step, n, text: df.select(F.lit(step).alias("step"), "project_id", n.cast("long").alias("n"), text.alias("told"))
    rows = [told(r, f"create {k}", F.col("n_changes"), F.coalesce("error", F.concat("message", F.lit(" "), F.array_join("preview.status", "")))) for k, r in enumerate(reports, 1)]
    rows.append(told(restored, "restore", F.col("dirty").cast("int"), F.col("error")))
    rows.append(told(store.list(), "list", F.col("place"), F.col("message")))
    rows.append(told(notes, "note", F.col("position"), F.md5("value")))
    return reduce(DataFrame.unionByName, rows)


def restore_preview(spark: SparkSession, d: str) -> DataFrame:
    """What restoring each source to its first checkpoint would undo, one unknown target included, without writing."""
    store, _, current = _cycle(spark, d)
    wanted = store.at(1).heads().withColumn("checkpoint_id", F.when(F.col("project_id") == "src2", F.lit("unknown")).otherwise(F.col("checkpoint_id")))
    return store.preview(current, wanted).drop("checkpoint_id")


def guarded_write(spark: SparkSession, d: str) -> DataFrame:
    """Changes every note and writes the new version, guarded by a scan of the sources' stores, some of which are cut off: its notes, and which sources were refused."""
    path = f"{shared_dir(spark)}/guarded-{uuid.uuid4().hex}"
    notes = _notes(spark, d)
    body = F.when(F.col("project_id").rlike("[37]$"), '[{"key": "cut').otherwise('[{"key": "whole"}]')
    notes.select("project_id").distinct().withColumn("value", body).write.partitionBy("project_id").text(f"{path}/stores")
    _, rejects = files.scan_notes(spark, f"{path}/stores/*/*.txt")
    rejects = rejects.withColumn("project_id", F.regexp_replace("project_id", "^project_id=", ""))
    report = files.write_guarded(notes.withColumn("value", F.concat("value", F.lit("!"))), rejects, f"{path}/table", 1, stored=notes)
    written = spark.read.schema(notes.schema).parquet(f"{path}/table/version=1").select("project_id", "key", F.md5("value").alias("value_md5"))
    return written.join(report, "project_id")


def request_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """A stream of requests, checkpoint requests of all kinds included, routed into tables over several micro-batches."""
    log = adapters.document_request_log(adapters.read(spark, d, "documents"))
    tables = fan_out.RoutedTables(spark, f"{shared_dir(spark)}/routed-{uuid.uuid4().hex}")
    tables.start(arrivals(log, F.col("request_id"), F.lit(False), "requests"), availableNow=True).awaitTermination()
    text = {
        "onboard": F.col("max_context_chars").cast("string"), "remember": F.concat_ws("=", "key", "value"), "recall": F.concat_ws("|", "limit", "key"),
        "checkpoint": F.concat_ws("|", "action", F.col("dry_run").cast("string"), "message", "checkpoint_id"), fan_out.DEAD: F.col("reason"),
    }
    rows = [tables.table(name).select("request_id", F.lit(name).alias("routed"), "project_id" if name != fan_out.DEAD else F.lit(None).cast("string").alias("project_id"), told.alias("told")) for name, told in text.items()]
    return reduce(DataFrame.unionByName, rows)


def gate_raw(spark: SparkSession, d: str) -> DataFrame:
    """Gate decisions on raw calls, and which of them are dead letters."""
    calls = adapters.document_calls(adapters.read(spark, d, "documents"))
    marked = adapters.read(spark, d, "documents").where("lang <> 'es'").select(F.col("lang").alias("project_id")).distinct()
    decided = gate.gate_events(hooks.parse_calls(calls), marked).select("event_id", "session_id", "project_id", "decision", "reason")
    dead = hooks.dead_calls(calls).select("event_id", F.md5("line").alias("dead_md5"))
    return decided.join(dead, "event_id", "left")


def initialise_projects(spark: SparkSession, d: str) -> DataFrame:
    """The documents that conversations and sources, which have none, lack; with those that are there."""
    docs = adapters.conversation_docs(adapters.read(spark, d, "conversations"))
    projects = docs.select("project_id").union(adapters.read(spark, d, "documents").select(F.concat(F.lit("home/"), "source")))
    added = context.initialise(projects, docs, dt.datetime(2024, 1, 1, 12))
    rows = added.withColumn("added", F.lit(True)).unionByName(docs.withColumn("added", F.lit(False)))
    return rows.select("project_id", "kind", F.md5("body").alias("body_md5"), "added")


def context_scan(spark: SparkSession, d: str) -> DataFrame:
    """Whole contexts, with their texts, from files of documents and settings."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    adapters.source_files(adapters.read(spark, d, "documents")).write.partitionBy("project_id", "kind").option("lineSep", "\x1e").text(path)
    kinds = {k: k for k in (*context.HEADINGS, "settings")}
    docs = files.scan_docs(spark, f"{path}/*/*/*.txt", kinds).withColumn("body", F.rtrim(F.col("body"), F.lit("\x1e")))
    settings = files.scan_settings(spark, f"{path}/*/kind=settings/*.txt")
    return context.contexts(docs, settings=settings, budget=20 * BUDGET).withColumn("project_id", F.regexp_replace("project_id", "^project_id=", ""))


def _status_lines(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("lang") == "en", " M ").when(F.col("lang") == "de", "?? ").otherwise("D  ")
    return adapters.read(spark, d, "documents").select(F.col("source").alias("project_id"), F.concat(code, F.col("doc_id").cast("string"), F.lit(".md")).alias("line"))


def status_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.parse_status(_status_lines(spark, d))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    marker = F.when(F.col("lang") == "en", MARKER).otherwise("")
    rows = adapters.read(spark, d, "documents").select(F.col("source").alias("project_id"), F.concat(F.left(F.md5("text"), F.lit(8)), F.lit(" "), marker, "lang", F.lit(f" {MARKER}"), F.col("n_chars").cast("string")).alias("line"))
    return lines.parse_log(rows)


def request_route(spark: SparkSession, d: str) -> DataFrame:
    served, dead = requests.route(adapters.requests(adapters.read(spark, d, "events")))
    out = dead.select("request_id", F.lit("dead").alias("routed"), F.lit(None).cast("string").alias("project_id"), F.lit(None).cast("int").alias("count"), "reason")
    count = {"onboard": "max_context_chars", "recall": "limit"}
    for tool, rows in served.items():
        out = out.unionByName(rows.select("request_id", F.lit(tool).alias("routed"), "project_id", (F.col(count[tool]) if tool in count else F.lit(None).cast("int")).alias("count"), F.lit(None).cast("string").alias("reason")))
    return out


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Users with a purchase of 50 or more have a marked project."""
    rich = adapters.read(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("value") >= 20))
    return gate.marked_projects(rich.select(F.col("user_id").cast("string").alias("project_id"), F.lit("map").alias("kind")))


def gate_batch(spark: SparkSession, d: str) -> DataFrame:
    events = adapters.tool_events(adapters.read(spark, d, "events"))
    return gate.gate_events(events, _marked(spark, d)).select("event_id", "session_id", "decision", "reason")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(adapters.read(spark, d, "events").schema).parquet(f"{d}/events.[p]arquet")  # a pattern: a plain path must be a folder


def gate_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = processors.gate_stream(adapters.tool_events(_stream(spark, d)), _marked(spark, d))
    return run_to_table(stream, "append", "gate").select("event_id", "session_id", "decision", "reason")


def note_fold_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = run_to_table(processors.fold_stream(adapters.note_events(_stream(spark, d))), "update", "fold")
    last = rows.groupBy("project_id", "key").agg(F.max_by(F.struct("value", "tags", "created_at", "updated_at", "position", "live"), "batch_id").alias("n")).select("project_id", "key", "n.*")
    return last.where("live").select("project_id", "key", "value", _tags(), _time("created_at"), _time("updated_at"), "position")


def note_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    """Writes all notes as JSON lines and scans them."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    files.write_note_lines(_notes(spark, d), path)
    notes, _ = files.scan_note_lines(spark, path)
    return notes.select("project_id", "key", F.md5("value").alias("value_md5"), _tags(), _time("updated_at"), "position")


def _out_of_order(events: DataFrame, seq: str, name: str) -> tuple[DataFrame, str]:
    """Events as a stream in which half of them come a micro-batch late or more, and the delay that bounds it."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    late = F.crc32(F.col(seq).cast("string").cast("binary")) % 2 == 1
    second = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    span = (last - first).total_seconds() if first else 0
    return arrivals(events, second, late, name), f"{int(3 * span / (ARRIVALS - 1)) + 60} seconds"


def note_fold_event_time(spark: SparkSession, d: str) -> DataFrame:
    """The fold of a stream that is out of order over micro-batches: the last row of each key."""
    stream, delay = _out_of_order(adapters.document_events(adapters.read(spark, d, "documents")), "seq", "late-notes")
    rows = run_to_table(event_time.fold_stream(stream, delay=delay), "update", "late-fold")
    last = rows.groupBy("project_id", "key").agg(F.max_by(F.struct("value", "tags", "created_at", "updated_at", "position", "live"), "batch_id").alias("n")).select("project_id", "key", "n.*")
    return last.where("live").select("project_id", "key", "value", _tags(), _time("created_at"), _time("updated_at"), "position")


def _late_gate(spark: SparkSession, d: str, per_project: bool) -> DataFrame:
    stream, delay = _out_of_order(adapters.document_tool_events(adapters.read(spark, d, "documents")), "event_id", "late-tools")
    marked = adapters.read(spark, d, "documents").where("lang <> 'es'").select(F.col("lang").alias("project_id")).distinct()
    rows = run_to_table(event_time.gate_stream(stream, marked, delay=delay, per_project=per_project), "update", "late-gate")
    last = rows.groupBy("event_id").agg(F.max_by(F.struct("session_id", "project_id", "decision", "reason"), "batch_id").alias("n"))
    return last.select("event_id", "n.*")


def gate_event_time(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on a stream that is out of order over micro-batches, those that late onboarding opened included."""
    return _late_gate(spark, d, per_project=False)


def gate_event_time_per_project(spark: SparkSession, d: str) -> DataFrame:
    """The same, where onboarding opens its own project alone."""
    return _late_gate(spark, d, per_project=True)


def snapshot_scan(spark: SparkSession, d: str) -> DataFrame:
    """Writes each source's notes as JSON arrays in as many files as its size takes, and scans the files."""
    path = f"{shared_dir(spark)}/stores-{uuid.uuid4().hex}"
    files.write_stores(_notes(spark, d), path)
    notes, _ = files.scan_notes(spark, f"{path}/*/*/*.txt")
    return notes.select(F.regexp_replace("project_id", "^project_id=", "").alias("project_id"), "key", F.md5("value").alias("value_md5"), _tags(), _time("updated_at"), "position")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        note_fold, note_actions, note_dedup_first, forget_batch, forget_report, recall_key, recall_query, recall_tags, recall_combined, recall_topk_per_project, recall_counts, recall_batch,
        recall_replies, project_registry, default_fill, note_summary, context_assemble, context_rows, change_set, change_set_tracked, diff_stat, checkpoint_list, checkpoint_targets, restore_state,
        status_lines, log_lines, request_route, gate_batch, gate_stream, note_fold_stream, snapshot_scan, note_fold_event_time, gate_event_time,
        gate_event_time_per_project, checkpoint_cycle, restore_preview, guarded_write, line_diff_stat, recall_many,
        request_fan_out, gate_raw, initialise_projects, context_scan, note_lines_scan,
    )
} | {"recent_notes": flagship}

# The same in SQL.

_TIME = "'%Y-%m-%d %H:%M:%S.%f'"
_NOTES = "notes AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS key, text AS value, lang AS tag, doc_id AS position, TIMESTAMP '2024-01-01' + to_seconds(n_chars) AS updated_at FROM documents)"
_LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS project_id, CAST(CAST(json_extract(props, '$.k') AS INTEGER) // 20 AS VARCHAR) AS key,
         CASE WHEN event_type = 'error' THEN 'forget' WHEN event_type IN ('click', 'signup') THEN 'append' ELSE 'replace' END AS op,
         CAST(event_id AS VARCHAR) AS value, event_type AS tag, ts, event_id AS seq FROM events)"""
_AT = "TIMESTAMP '2024-01-01' + to_seconds(doc_id * 600)"
_DOC_LOG = f"""log AS (
  SELECT source AS project_id, CAST(n_chars % 10 AS VARCHAR) AS key, CASE WHEN n_chars % 11 = 3 THEN 'forget' WHEN n_chars % 3 = 0 THEN 'replace' ELSE 'append' END AS op,
         md5(text) AS value, lang AS tag, {_AT} AS ts, doc_id AS seq FROM documents)"""
_FOLD_STEPS = """epochs AS (
  SELECT *, sum(CAST(op = 'forget' AS INT)) OVER (PARTITION BY project_id, key ORDER BY ts, seq) AS epoch FROM log
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY ts, seq) AS rn
  FROM (SELECT *, max(epoch) OVER (PARTITION BY project_id, key) AS last FROM epochs) WHERE op <> 'forget' AND epoch = last
), based AS (
  SELECT *, max(CASE WHEN op = 'replace' OR rn = 1 THEN rn END) OVER (PARTITION BY project_id, key) AS base FROM kept
), folded AS (
  SELECT project_id, key, string_agg(value, chr(10) ORDER BY rn) FILTER (WHERE rn >= base) AS value, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags,
         min(ts) AS created_at, max(ts) AS updated_at, arg_min(seq, rn) AS position FROM based GROUP BY project_id, key)"""
_FOLD = f"{_LOG}, {_FOLD_STEPS}"
_ALL_FOLDED = f"SELECT project_id, key, value, tags, strftime(created_at, {_TIME}) AS created_at, strftime(updated_at, {_TIME}) AS updated_at, position FROM folded"
_FOLDED = f"WITH {_FOLD} {_ALL_FOLDED}"
_FORGET = f"""WITH {_NOTES}, german AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE lang = 'de'),
gone AS (SELECT * FROM german UNION ALL SELECT project_id, 'x' || key FROM german), left_over AS (SELECT * FROM notes n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.project_id = n.project_id AND g.key = n.key))"""
_HAS = f"(contains(lower(key), lower('{QUERY}')) OR contains(lower(value), lower('{QUERY}')))"
_RECALL = f"""WITH {_NOTES}, request(request_id, rp, rk, rq, rt, rn) AS (VALUES
  (1, 'src1', NULL, 'tion', NULL, 5), (2, 'src1', NULL, NULL, 'de', NULL), (3, 'src2', '22', 'ignored', NULL, 3), (4, 'src2', 'nokey', NULL, NULL, NULL),
  (5, 'nowhere', NULL, 'x', NULL, NULL), (6, 'src0', '', '', NULL, 4), (7, 'src4', NULL, '%', NULL, NULL)),
found AS (
  SELECT *, CASE WHEN coalesce(rk, '') <> '' THEN 1 ELSE coalesce(rn, 10) END AS top FROM request JOIN notes ON rp = project_id
  AND CASE WHEN coalesce(rk, '') <> '' THEN key = rk ELSE (rt IS NULL OR tag = rt) AND (coalesce(rq, '') = '' OR contains(lower(key), lower(rq)) OR contains(lower(value), lower(rq))) END)"""
_DOCS = "docs AS (SELECT CAST(conv_id AS VARCHAR) AS project_id, CASE role WHEN 'system' THEN 'settings' WHEN 'user' THEN 'map' ELSE 'task' END AS kind, text AS body FROM conversations)"
_BETWEEN = context.BETWEEN
_SUMMARY = f"""{_NOTES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY position) AS i, count(*) OVER (PARTITION BY project_id) AS n FROM notes),
        summaries AS (SELECT project_id, chr(10) || chr(10) || '## Stored Memories (' || any_value(n) || ' total)' || chr(10) || string_agg('- **' || key || '** [' || tag || ']' || chr(10), '' ORDER BY i) FILTER (WHERE i <= 10)
        || CASE WHEN any_value(n) > 10 THEN '- ... and ' || (any_value(n) - 10) || ' more' || chr(10) ELSE '' END AS summary, any_value(n) AS n_notes FROM numbered GROUP BY project_id)"""
_DEFAULTS = ", ".join(f"('{k}', '{v.rstrip()}' || chr(10))" for k, v in context.DEFAULT_DOCS.items())
_VERSIONS = """old AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS key, text AS value FROM documents WHERE lang <> 'es'),
new AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS key, CASE WHEN lang = 'fr' THEN text || chr(10) || 'extra' ELSE text END AS value FROM documents WHERE lang <> 'de')"""
_CHANGES = f"""WITH {_VERSIONS} SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.key, n.key) AS key,
CASE WHEN o.key IS NULL THEN 'A' WHEN n.key IS NULL THEN 'D' ELSE 'M' END AS status
FROM old o FULL JOIN new n ON o.project_id = n.project_id AND o.key = n.key WHERE o.value IS DISTINCT FROM n.value"""
_WALK = f"""m AS (
  SELECT CAST(o_custkey AS VARCHAR) AS project_id, CAST(o_orderkey AS VARCHAR) AS id, CAST(lag(o_orderkey) OVER w AS VARCHAR) AS parent, row_number() OVER w AS seq,
         o_orderpriority AS message, CAST(o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS INT) AS marked
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), walk AS (
  SELECT m.*, marked AS place FROM m WHERE seq = (SELECT max(seq) FROM m x WHERE x.project_id = m.project_id)
  UNION ALL SELECT m.*, w.place + m.marked FROM walk w JOIN m ON m.project_id = w.project_id AND m.id = w.parent WHERE w.place < {checkpoints.LISTED}
)"""
_GATE = """
WITH marked AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value >= 20),
e AS (SELECT *, max(CAST(event_type = 'signup' AND user_id IN (SELECT user_id FROM marked) AS INT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS onboarded FROM events)
SELECT event_id, CAST(user_id AS VARCHAR) AS session_id,
       CASE WHEN event_type IN ('click', 'purchase') AND value >= 5 AND onboarded = 0 AND user_id IN (SELECT user_id FROM marked) THEN 'block' ELSE 'allow' END AS decision,
       CASE WHEN event_type = 'error' THEN 'malformed' WHEN event_type IN ('click', 'purchase') AND value >= 5 AND onboarded = 0 AND user_id IN (SELECT user_id FROM marked) THEN 'onboard first' END AS reason
FROM e"""


def _doc_gate_sql(by: str, raw: bool = False) -> str:
    line = """'{"tool_name":"' || CASE WHEN n = 0 THEN 'onboard' WHEN n <= 9 THEN 'Edit' WHEN n <= 14 THEN 'Write' ELSE 'Read' END || '","cwd":"/home/work/' || lang || '/","tool_input":{"file_path":"' || CASE WHEN exempt THEN '.claude/map.md' ELSE 'src/' || md5(text) END || '"}}'"""
    if raw:
        return f"""
WITH d AS (SELECT *, n_chars % 20 AS n, n_chars % 7 = 0 AS exempt, n_chars % 9 = 0 AS cut FROM documents),
l AS (SELECT *, CASE WHEN n = 19 THEN replace({line}, '"tool_name":"Read",', '') ELSE {line} END AS line FROM d),
e AS (SELECT doc_id AS event_id, source AS session_id, CASE WHEN NOT cut THEN lang END AS project_id, n, exempt, lang <> 'es' AND NOT cut AS marked, {_AT} AS ts, cut, CASE WHEN cut THEN md5(left(line, length(line) - 2)) END AS dead_md5 FROM l),
o AS (SELECT *, max(CAST(n = 0 AND marked AS INT)) OVER (PARTITION BY {by}, CAST(ts AS DATE) ORDER BY ts, event_id) AS opened FROM e),
b AS (SELECT *, n BETWEEN 1 AND 14 AND marked AND NOT exempt AND opened = 0 AS blocked FROM o)
SELECT event_id, session_id, project_id, CASE WHEN blocked THEN 'block' ELSE 'allow' END AS decision, CASE WHEN cut THEN 'malformed' WHEN blocked THEN 'onboard first' END AS reason, dead_md5 FROM b"""
    return f"""
WITH e AS (SELECT doc_id AS event_id, source AS session_id, lang AS project_id, n_chars % 20 AS n, n_chars % 7 = 0 AS exempt, lang <> 'es' AS marked, {_AT} AS ts FROM documents),
o AS (SELECT *, max(CAST(n = 0 AND marked AS INT)) OVER (PARTITION BY {by}, CAST(ts AS DATE) ORDER BY ts, event_id) AS opened FROM e),
b AS (SELECT *, n BETWEEN 1 AND 14 AND marked AND NOT exempt AND opened = 0 AS blocked FROM o)
SELECT event_id, session_id, project_id, CASE WHEN blocked THEN 'block' ELSE 'allow' END AS decision, CASE WHEN n = 19 THEN 'malformed' WHEN blocked THEN 'onboard first' END AS reason FROM b"""


ORACLE_SQL: dict[str, str] = {
    "note_fold_event_time": f"WITH {_DOC_LOG}, {_FOLD_STEPS} {_ALL_FOLDED}",
    "gate_event_time": _doc_gate_sql("session_id"),
    "gate_raw": _doc_gate_sql("session_id", raw=True),
    "request_fan_out": """WITH r AS (SELECT *, n_chars % 12 AS k, n_chars % 5 AS v FROM documents),
        j AS (SELECT *, CASE WHEN k = 1 THEN 'missing message' WHEN k = 4 THEN 'unknown action' WHEN k = 6 THEN 'missing value' WHEN k IN (7, 11) AND v = 0 THEN 'bad limit' WHEN k = 9 THEN 'unknown tool' WHEN k = 10 THEN 'unreadable arguments' END AS reason FROM r)
        SELECT doc_id AS request_id, CASE WHEN reason IS NOT NULL THEN 'dead' WHEN k <= 4 THEN 'checkpoint' WHEN k <= 6 THEN 'remember' WHEN k IN (7, 11) THEN 'recall' ELSE 'onboard' END AS routed, CASE WHEN reason IS NULL THEN source END AS project_id,
               CASE WHEN reason IS NOT NULL THEN reason
                    WHEN k <= 4 THEN concat_ws('|', CASE k WHEN 0 THEN 'create' WHEN 2 THEN 'list' ELSE 'rollback' END, CASE WHEN v = 0 THEN 'true' ELSE 'false' END, CASE WHEN k = 0 THEN md5(text) END, CASE WHEN k = 3 THEN left(md5(text), 8) END)
                    WHEN k <= 6 THEN concat_ws('=', CAST(doc_id AS VARCHAR), md5(text)) WHEN k IN (7, 11) THEN concat_ws('|', CAST(v - 1 AS VARCHAR), CASE WHEN k = 11 THEN CAST(doc_id AS VARCHAR) END)
                    ELSE CAST(CASE WHEN v = 0 THEN n_chars ELSE 50000 END AS VARCHAR) END AS told FROM j""",
    "initialise_projects": f"""WITH {_DOCS}, defaults(kind, body) AS (VALUES {_DEFAULTS}, ('settings', NULL)),
        p AS (SELECT project_id, project_id AS name FROM docs UNION SELECT 'home/' || source, source FROM documents)
        SELECT p.project_id, d.kind, md5(coalesce(d.body, '{{"project_name":"' || name || '","version":"4.0","created_at":"2024-01-01T12:00:00"}}')) AS body_md5, true AS added
        FROM p CROSS JOIN defaults d WHERE NOT EXISTS (SELECT 1 FROM docs o WHERE o.project_id = p.project_id AND o.kind = d.kind)
        UNION ALL SELECT project_id, kind, md5(body), false FROM docs""",
    "context_scan": f"""WITH m AS (SELECT source AS project_id, lang, arg_max(text, n_chars * 10000000 + doc_id) AS body, max(n_chars) AS n FROM documents GROUP BY source, lang),
        parts AS (SELECT project_id, lang, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS place, CASE lang WHEN 'en' THEN '# Project Map' WHEN 'de' THEN '# Decisions' ELSE '# Current Task' END || chr(10) || chr(10) || body AS s FROM m WHERE lang <> 'es'),
        c AS (SELECT project_id, string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS t, bool_or(lang = 'en') AS map_found, bool_or(lang = 'de') AS decisions_found, bool_or(lang = 'fr') AS task_found FROM parts GROUP BY project_id),
        s AS (SELECT project_id, n FROM m WHERE lang = 'es'),
        f AS (SELECT project_id, s.n, length(coalesce(t, '')) > {20 * BUDGET} AS truncated, CASE WHEN length(t) > {20 * BUDGET} THEN substring(t, 1, {20 * BUDGET}) || chr(10) || chr(10) || '[TRUNCATED - context exceeds limit]' ELSE coalesce(t, '') END AS context, map_found, decisions_found, task_found FROM c FULL JOIN s USING (project_id))
        SELECT project_id, n IS NOT NULL AS initialised, CASE WHEN n % 2 = 0 THEN 'Project ' || project_id WHEN n IS NOT NULL THEN 'project_id=' || project_id ELSE 'project_id=' || project_id END AS project_name, CASE WHEN n % 2 = 0 THEN '5.' || n ELSE '4.0' END AS version, context, length(context) AS context_size, truncated,
               coalesce(map_found, false) AS map_found, coalesce(decisions_found, false) AS decisions_found, coalesce(task_found, false) AS task_found, false AS memories_found FROM f""",
    "gate_event_time_per_project": _doc_gate_sql("session_id, project_id"),
    "note_fold": _FOLDED,
    "note_fold_stream": _FOLDED,
    "recent_notes": f"""WITH {_FOLD} SELECT project_id, rank, key, value, tags, strftime(updated_at, {_TIME}) AS updated_at FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC NULLS LAST, position) AS rank FROM folded WHERE contains(key, '1') OR contains(value, '1')) WHERE rank <= 10""",
    "note_actions": f"""WITH {_LOG}, a AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY project_id, key ORDER BY ts, seq) <> 'forget', false) AS live FROM log),
        l AS (SELECT *, CASE WHEN op = 'forget' THEN CASE WHEN live THEN 'deleted' ELSE 'not_found' END WHEN live THEN 'updated' ELSE 'created' END AS action FROM a)
        SELECT project_id, key, seq, action, tag AS tags, CAST(sum(CASE action WHEN 'created' THEN 1 WHEN 'deleted' THEN -1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY ts, seq) AS BIGINT) AS total FROM l""",
    "note_dedup_first": "SELECT source AS project_id, md5(text) AS key, min(doc_id) AS position FROM documents GROUP BY source, md5(text)",
    "forget_batch": f"{_FORGET} SELECT project_id, key, position FROM left_over",
    "forget_report": f"""{_FORGET} SELECT g.project_id, g.key, n.key IS NOT NULL AS deleted, coalesce(r.c, 0) AS remaining, CASE WHEN n.key IS NULL THEN 'not found' END AS error
        FROM gone g LEFT JOIN notes n USING (project_id, key) LEFT JOIN (SELECT project_id, count(*) AS c FROM left_over GROUP BY project_id) r ON r.project_id = g.project_id""",
    "recall_key": f"WITH {_NOTES} SELECT project_id, key, value, strftime(updated_at, {_TIME}) AS updated_at FROM notes WHERE project_id = '{PROJECT}' AND key = '{KEY}'",
    "recall_query": f"WITH {_NOTES} SELECT project_id, key, tag AS tags FROM notes WHERE {_HAS}",
    "recall_tags": f"WITH {_NOTES} SELECT project_id, key, tag AS tags FROM notes WHERE tag IN {TAGS}",
    "recall_combined": f"WITH {_NOTES} SELECT project_id, key, strftime(updated_at, {_TIME}) AS updated_at FROM notes WHERE project_id = '{PROJECT}' AND tag IN ('en', 'fr') AND {_HAS} ORDER BY updated_at DESC, position LIMIT 10",
    "recall_topk_per_project": f"WITH {_NOTES} SELECT project_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, position) AS rank FROM notes WHERE tag IN ('en', 'fr') AND {_HAS}) WHERE rank <= 10",
    "recall_counts": f"WITH {_NOTES} SELECT project_id, least(h, 10) AS hits, total, CASE WHEN h = 0 THEN 'no match' END AS message FROM (SELECT project_id, count(*) AS total, count(*) FILTER (WHERE tag IN {TAGS} AND {_HAS}) AS h FROM notes GROUP BY project_id)",
    "recall_batch": f"{_RECALL} SELECT request_id, project_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN coalesce(rk, '') = '' THEN updated_at END DESC NULLS LAST, position) AS rank FROM found) WHERE rank <= top",
    "recall_replies": f"""{_RECALL} SELECT request_id, rp AS project_id, least(coalesce(h, 0), coalesce(top, 10)) AS hits, coalesce(total, 0) AS total,
        CASE WHEN coalesce(total, 0) = 0 THEN 'no notes stored' WHEN coalesce(h, 0) = 0 THEN CASE WHEN coalesce(rk, '') <> '' THEN 'no note with key ' || rk ELSE 'no match' END END AS message
        FROM request LEFT JOIN (SELECT request_id, count(*) AS h, any_value(top) AS top FROM found GROUP BY request_id) USING (request_id)
        LEFT JOIN (SELECT project_id, count(*) AS total FROM notes GROUP BY project_id) t ON t.project_id = rp""",
    "recall_many": f"""WITH {_NOTES}, r AS (SELECT doc_id AS request_id, source AS rp, CASE WHEN n_chars % 4 = 0 THEN CAST(doc_id + n_chars % 3 AS VARCHAR) END AS rk, CASE WHEN n_chars % 4 IN (1, 2) THEN translate(substring(text, 3, 12), '{string.ascii_lowercase}', '{string.ascii_uppercase}') END AS rq,
          CASE WHEN n_chars % 4 = 2 THEN 'en' WHEN n_chars % 8 = 3 THEN lang END AS rt, CASE WHEN n_chars % 4 = 0 THEN 1 WHEN n_chars % 5 <> 4 THEN n_chars % 5 ELSE 10 END AS top FROM documents),
        found AS (SELECT request_id, project_id, key, value, top, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN rk IS NULL THEN updated_at END DESC NULLS LAST, position) AS rank
          FROM r JOIN notes ON rp = project_id AND CASE WHEN rk IS NOT NULL THEN key = rk ELSE (rt IS NULL OR tag = rt) AND (coalesce(rq, '') = '' OR contains(lower(key), lower(rq)) OR contains(lower(value), lower(rq))) END)
        SELECT request_id, rank, project_id, key, md5(value) AS value_md5 FROM found WHERE rank <= top""",
    "project_registry": f"WITH {_DOCS}, f AS (SELECT project_id, bool_or(kind = 'settings') AS initialised FROM docs GROUP BY project_id) SELECT project_id, initialised, CASE WHEN NOT initialised THEN 'not initialised' END AS error FROM f",
    "default_fill": f"""WITH {_DOCS}, defaults(kind, body) AS (VALUES {_DEFAULTS}), own AS (SELECT project_id, kind, min(body) AS body FROM docs GROUP BY project_id, kind)
        SELECT p.project_id, d.kind, md5(coalesce(o.body, d.body)) AS body_md5, o.body IS NULL AS filled
        FROM (SELECT DISTINCT project_id FROM docs) p CROSS JOIN defaults d LEFT JOIN own o ON o.project_id = p.project_id AND o.kind = d.kind""",
    "note_summary": f"WITH {_SUMMARY} SELECT project_id, summary, n_notes FROM summaries",
    "context_rows": f"""WITH {_DOCS}, {_SUMMARY}, one AS (SELECT project_id, kind, min(body) AS body FROM docs GROUP BY project_id, kind),
        parts AS (SELECT project_id, 0 AS place, '# Project Map' || chr(10) || chr(10) || body AS s FROM one WHERE kind = 'map' AND body <> ''
                  UNION ALL SELECT project_id, 2, '# Current Task' || chr(10) || chr(10) || body FROM one WHERE kind = 'task' AND body <> '' UNION ALL SELECT project_id, 3, summary FROM summaries),
        c AS (SELECT project_id, length(string_agg(s, '{_BETWEEN}' ORDER BY place)) AS n, bool_or(place = 0) AS m, bool_or(place = 2) AS t, bool_or(place = 3) AS f FROM parts GROUP BY project_id),
        r AS (SELECT project_id, bool_or(kind = 'settings') AS i FROM one GROUP BY project_id)
        SELECT coalesce(r.project_id, c.project_id) AS project_id, coalesce(i, false) AS initialised, coalesce(r.project_id, c.project_id) AS project_name, '4.0' AS version,
               CASE WHEN coalesce(n, 0) > {BUDGET} THEN {BUDGET + len(context.CUT_SUFFIX)} ELSE coalesce(n, 0) END AS context_size, coalesce(n, 0) > {BUDGET} AS truncated,
               coalesce(m, false) AS map_found, false AS decisions_found, coalesce(t, false) AS task_found, coalesce(f, false) AS memories_found
        FROM r FULL JOIN c ON c.project_id = r.project_id""",
    "context_assemble": f"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS project_id, string_agg('# ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
        f AS (SELECT project_id, length(t) > {BUDGET} AS truncated, CASE WHEN length(t) > {BUDGET} THEN substring(t, 1, {BUDGET}) || chr(10) || chr(10) || '[TRUNCATED - context exceeds limit]' ELSE t END AS context FROM c)
        SELECT project_id, context, length(context) AS context_size, truncated FROM f""",
    "change_set": _CHANGES,
    "change_set_tracked": f"SELECT * FROM ({_CHANGES}) WHERE status <> 'A'",
    "diff_stat": f"""WITH {_VERSIONS}, l AS (SELECT project_id, key, unnest(string_split(value, chr(10))) AS line, -1 AS n FROM old UNION ALL SELECT project_id, key, unnest(string_split(value, chr(10))), 1 FROM new),
        d AS (SELECT project_id, key, line, sum(n) AS n FROM l GROUP BY ALL HAVING sum(n) <> 0)
        SELECT project_id, key, CAST(sum(greatest(n, 0)) AS BIGINT) AS insertions, CAST(sum(greatest(-n, 0)) AS BIGINT) AS deletions FROM d GROUP BY project_id, key""",
    "line_diff_stat": """WITH t AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS key, lang, text, string_split(text, chr(10)) AS l FROM documents WHERE lang IN ('en', 'fr') AND text IS NOT NULL)
        SELECT project_id, key, CAST(1 AS BIGINT) AS insertions, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS BIGINT) AS deletions FROM t
        WHERE lang = 'fr' OR array_to_string(list_concat(l[2:], l[1:1]), chr(10)) <> text""",
    "checkpoint_list": f"WITH RECURSIVE {_WALK} SELECT project_id, CAST(place AS BIGINT) AS place, id AS checkpoint_id, message FROM walk WHERE marked = 1",
    "checkpoint_targets": f"""WITH RECURSIVE {_WALK}, newest AS (SELECT project_id, id FROM walk WHERE marked = 1 AND place = 1),
        a AS (SELECT CAST(c_custkey AS VARCHAR) AS project_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey AS VARCHAR) END AS given FROM customer),
        t AS (SELECT a.project_id, coalesce(given, newest.id) AS checkpoint_id FROM a LEFT JOIN newest USING (project_id))
        SELECT t.project_id, t.checkpoint_id, CASE WHEN t.checkpoint_id IS NULL THEN 'no checkpoints' WHEN m.id IS NULL THEN 'not found' END AS error FROM t LEFT JOIN m ON m.project_id = t.project_id AND m.id = t.checkpoint_id""",
    "restore_state": f"WITH {_VERSIONS} SELECT project_id, key, md5(value) AS value_md5 FROM old WHERE project_id <> 'src1' AND project_id IN (SELECT project_id FROM new) UNION ALL SELECT project_id, key, md5(value || '!') FROM new WHERE project_id = 'src1'",
    "checkpoint_cycle": f"""WITH {_VERSIONS},
        c1 AS (SELECT project_id, key, 'A' AS status FROM old), c2 AS ({_CHANGES.replace("WITH " + _VERSIONS, "")}),
        n1 AS (SELECT project_id, count(*) AS n, string_agg(status, '' ORDER BY key) FILTER (WHERE i <= {checkpoints.PREVIEW}) AS s FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY key) AS i FROM c1) GROUP BY project_id),
        n2 AS (SELECT project_id, count(*) AS n, string_agg(status, '' ORDER BY key) FILTER (WHERE i <= {checkpoints.PREVIEW}) AS s FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY key) AS i FROM c2) GROUP BY project_id),
        p AS (SELECT project_id FROM old UNION SELECT project_id FROM new), dirty AS (SELECT DISTINCT project_id FROM new WHERE project_id = 'src1'),
        done AS (SELECT project_id FROM n1 WHERE project_id NOT IN (SELECT project_id FROM dirty))
        SELECT 'create 1' AS step, project_id, n, '{MARKER}first ' || s AS told FROM n1
        UNION ALL SELECT 'create 2', project_id, n, CASE WHEN n IS NULL THEN 'no changes' ELSE '{MARKER}second ' || s END FROM p LEFT JOIN n2 USING (project_id)
        UNION ALL SELECT 'restore', project_id, CAST(project_id IN (SELECT project_id FROM dirty) AS BIGINT), CASE WHEN project_id IN (SELECT project_id FROM dirty) THEN 'there are changes that no checkpoint holds' END FROM n1
        UNION ALL SELECT 'list', project_id, 1, 'second' FROM n2 WHERE project_id NOT IN (SELECT project_id FROM done)
        UNION ALL SELECT 'list', project_id, CASE WHEN project_id IN (SELECT project_id FROM done) OR project_id NOT IN (SELECT project_id FROM n2) THEN 1 ELSE 2 END, 'first' FROM n1
        UNION ALL SELECT 'note', project_id, CAST(key AS BIGINT), md5(value) FROM old WHERE project_id IN (SELECT project_id FROM done)
        UNION ALL SELECT 'note', project_id, CAST(key AS BIGINT), md5(CASE WHEN project_id = 'src1' THEN value || '!' ELSE value END) FROM new WHERE project_id NOT IN (SELECT project_id FROM done)""",
    "restore_preview": f"""WITH {_VERSIONS}, now AS (SELECT project_id, key, CASE WHEN project_id = 'src1' THEN value || '!' ELSE value END AS value FROM new),
        l AS (SELECT project_id, key, unnest(string_split(value, chr(10))) AS line, -1 AS n FROM old WHERE project_id <> 'src2' UNION ALL SELECT project_id, key, unnest(string_split(value, chr(10))), 1 FROM now WHERE project_id IN (SELECT project_id FROM old) AND project_id <> 'src2'),
        s AS (SELECT project_id, key, CAST(sum(greatest(n, 0)) AS BIGINT) AS insertions, CAST(sum(greatest(-n, 0)) AS BIGINT) AS deletions FROM (SELECT project_id, key, line, sum(n) AS n FROM l GROUP BY ALL HAVING sum(n) <> 0) GROUP BY project_id, key)
        SELECT w.project_id, w.project_id = 'src1' AND w.project_id IN (SELECT project_id FROM new) AS dirty, CASE WHEN w.project_id = 'src2' THEN 'not found' END AS error, key, insertions, deletions
        FROM (SELECT DISTINCT project_id FROM old) w LEFT JOIN s ON s.project_id = w.project_id""",
    "guarded_write": """WITH n AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS key, text, NOT regexp_matches(source, '[37]$') AS written FROM documents)
        SELECT project_id, key, md5(CASE WHEN written THEN text || '!' ELSE text END) AS value_md5, count(*) OVER (PARTITION BY project_id) AS n_notes, written, CASE WHEN NOT written THEN 'a store of the project could not be read' END AS error FROM n""",
    "status_lines": "SELECT source AS project_id, CASE lang WHEN 'en' THEN 'M' WHEN 'de' THEN '??' ELSE 'D' END AS status, doc_id || '.md' AS file FROM documents",
    "log_lines": f"SELECT source AS project_id, substring(md5(text), 1, 8) AS checkpoint_id, lang || ' {MARKER}' || n_chars AS message, lang = 'en' AS marked FROM documents",
    "request_route": """
        WITH r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'unknown tool' WHEN event_type = 'purchase' AND value < 10 THEN 'missing value' WHEN event_type = 'view' AND (value < 0 OR value <> floor(value)) THEN 'bad limit' END AS reason FROM events)
        SELECT event_id AS request_id, CASE WHEN reason IS NOT NULL THEN 'dead' WHEN event_type = 'signup' THEN 'onboard' WHEN event_type = 'view' THEN 'recall' ELSE 'remember' END AS routed,
               CASE WHEN reason IS NULL THEN CAST(user_id AS VARCHAR) END AS project_id,
               CASE WHEN reason IS NULL AND event_type = 'signup' THEN 50000 WHEN reason IS NULL AND event_type = 'view' THEN CAST(value AS INTEGER) END AS count, reason FROM r""",
    "gate_batch": _GATE,
    "gate_stream": _GATE,
    "note_lines_scan": f"WITH {_NOTES} SELECT project_id, key, md5(value) AS value_md5, tag AS tags, strftime(updated_at, {_TIME}) AS updated_at, position FROM notes",
    "snapshot_scan": f"SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS key, md5(text) AS value_md5, lang AS tags, strftime(TIMESTAMP '2024-01-01' + to_seconds(n_chars), {_TIME}) AS updated_at, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents",
}
