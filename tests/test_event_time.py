"""Streams in event time: out of order over micro-batches, with state that ends."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from notes_engine import schemas
from notes_engine.operators import fold, gate
from notes_engine.streaming import event_time, processors
from notes_engine.streaming.runs import arrivals, run_to_table
from test_context import tool_events
from test_notes import DAY, log, numbered


def in_files(spark, batches, schema, tmp_path):
    """A stream of lists of rows, a micro-batch each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def shuffled(rows, time, batches, reach, rng):
    """Rows dealt into micro-batches by time, some up to `reach` batches late."""
    out = [[] for _ in range(batches + reach)]
    low, high = min(map(time, rows)), max(map(time, rows))
    for r in rows:
        out[int((time(r) - low) / ((high - low) * 1.0001) * batches) + rng.randint(0, reach)].append(r)
    for part in out:
        rng.shuffle(part)
    return out


def last_notes(rows):
    fields = F.struct("value", "tags", "created_at", "updated_at", "position", "live")
    last = rows.groupBy("project_id", "key").agg(F.max_by(fields, "batch_id").alias("n")).select("project_id", "key", "n.*")
    return sorted((r.project_id, r.key, r.value, r.tags, r.created_at, r.updated_at, r.position) for r in last.where("live").collect())


def test_fold_of_shuffled_events_is_the_batch_fold(spark, tmp_path):
    rng = random.Random(7)
    ops = rng.choices(["replace", "append", "forget"], [2, 6, 1], k=300)
    events = numbered([("p", rng.choice("abcd"), op, rng.choice([None, f"v{i}"]), rng.choice([None, [], ["x"], ["y", None]]), 10 * (i // 2)) for i, op in enumerate(ops)])
    rows = log(spark, events).collect()
    stream = in_files(spark, [[tuple(r) for r in part] for part in shuffled(rows, lambda r: r.ts.timestamp(), 6, 2, rng)], schemas.NOTE_EVENTS, tmp_path)
    got = run_to_table(event_time.fold_stream(stream, delay="900 minutes"), "update", "shuffled")
    want = fold.fold_notes(log(spark, events)).collect()
    assert last_notes(got) == sorted((r.project_id, r.key, r.value, r.tags, r.created_at, r.updated_at, r.position) for r in want)
    assert got.select("batch_id").distinct().count() >= 6


def state_rows(stream, mode, path):
    """Rows of the keyed state after each micro-batch, and rows dropped as late."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, k: rows.write.format("noop").mode("overwrite").save()).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    progress = [json.loads(p.json)["stateOperators"][0] for p in query.recentProgress]
    return [p["numRowsTotal"] for p in progress], sum(p["numRowsDroppedByWatermark"] for p in progress)


def test_late_events_are_dropped_and_forgotten_keys_leave_no_state(spark, tmp_path):
    at = lambda h: DAY + dt.timedelta(hours=h)
    event = lambda k, op, h, s: ("p", k, op, f"{k}{s}", None, at(h), s)
    batches = [
        [event(f"k{i}", "replace", 0, i) for i in range(50)],
        [event(f"k{i}", "forget", 1, 100 + i) for i in range(50)],
        [event("z", "replace", 50, 200)],
        [event("z", "append", 49, 204)],  # out of order, within the delay
        [event("z", "append", 20, 201), event("z", "append", 51, 202)],  # the first is older than the watermark of the batch before
        [event("z", "append", 52, 203)],
    ]
    stream = in_files(spark, batches, schemas.NOTE_EVENTS, tmp_path)
    rows, dropped = state_rows(event_time.fold_stream(stream, delay="2 hours"), "update", tmp_path)
    assert dropped == 1 and max(rows) > 100 and rows[-1] < 12
    again = run_to_table(event_time.fold_stream(stream, delay="2 hours"), "update", "late")
    assert [r[:3] for r in last_notes(again)] == [("p", "z", "z200\nz202\nz203")] and again.where("value LIKE '%z201%'").count() == 0


def test_a_key_of_many_events_is_kept_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_time, "AT_ONCE", 7)
    rng = random.Random(2)
    events = numbered([("p", "k", rng.choice(["append", "append", "replace"]), f"v{i}", [rng.choice("abc")], i) for i in range(400)])
    rows = log(spark, events).collect()
    stream = in_files(spark, [[tuple(r) for r in part] for part in shuffled(rows, lambda r: r.ts.timestamp(), 4, 1, rng)], schemas.NOTE_EVENTS, tmp_path)
    got = run_to_table(event_time.fold_stream(stream, delay="250 minutes"), "update", "many")
    (want,) = fold.fold_notes(log(spark, events)).collect()
    assert [r[2:4] for r in last_notes(got)] == [(want.value, want.tags)]


@pytest.mark.parametrize("per_project", [False, True])
def test_gate_of_shuffled_events_is_the_batch_gate(spark, tmp_path, per_project):
    rng = random.Random(11)
    events = [(rng.choice("st"), rng.choice("pqu"), rng.choice(["Edit", "Write", "Read", None, "Edit", "onboard"] if i % 9 else ["onboard"]), rng.choice([None, "a.py", "x/.claude/m"]), 25 * i) for i in range(500)]
    marked = spark.createDataFrame([("p",), ("q",)], "project_id string")
    table = tool_events(spark, events)
    parts = shuffled(table.collect(), lambda r: r.ts.timestamp(), 6, 2, rng)
    stream = in_files(spark, [[tuple(r) for r in part] for part in parts], schemas.TOOL_EVENTS, tmp_path)
    got = run_to_table(event_time.gate_stream(stream, marked, delay="5 days", per_project=per_project), "update", "gate")
    last = got.groupBy("event_id").agg(F.max_by(F.struct("session_id", "project_id", "tool_name", "decision", "reason"), "batch_id").alias("n")).select("event_id", "n.*")
    want = gate.gate_events(table, marked, per_project=per_project).select(last.columns)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    again = got.groupBy("event_id").count().where("count > 1").count()
    assert again > 0 and got.groupBy("event_id").count().agg(F.max("count")).first()[0] == 2  # opened by late onboarding


def test_gate_state_holds_the_days_within_the_delay(spark, tmp_path):
    marked = spark.createDataFrame([("p",)], "project_id string")
    batches = [[(f"s{i}", "p", "Edit", "a", DAY + dt.timedelta(days=d, minutes=i), 100 * d + i) for i in range(60)] for d in range(8)]
    stream = in_files(spark, batches, schemas.TOOL_EVENTS, tmp_path)
    rows, dropped = state_rows(event_time.gate_stream(stream, marked, delay="1 day"), "update", tmp_path)
    assert dropped == 0 and max(rows[3:]) <= 1.05 * rows[3]


def test_days_that_share_a_bucket_end_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(processors, "BUCKETS", 2)
    monkeypatch.setattr(event_time, "AT_ONCE", 7)
    rng = random.Random(4)
    events = [(rng.choice(["s", "t", None]), rng.choice("pqu"), "onboard" if i % 9 == 0 else rng.choice(["Edit", "Write", "Read", None]), rng.choice([None, "a.py"]), 30 * i) for i in range(500)]
    marked, table = spark.createDataFrame([("p",), ("q",)], "project_id string"), tool_events(spark, events)
    parts = shuffled(table.collect(), lambda r: r.ts.timestamp(), 8, 1, rng)
    stream = in_files(spark, [[tuple(r) for r in part] for part in parts], schemas.TOOL_EVENTS, tmp_path)
    got = run_to_table(event_time.gate_stream(stream, marked, delay="3 days", per_project=True), "update", "shared")
    last = got.groupBy("event_id").agg(F.max_by(F.struct("session_id", "project_id", "tool_name", "decision", "reason"), "batch_id").alias("n")).select("event_id", "n.*")
    want = gate.gate_events(table, marked, per_project=True).select(last.columns)
    assert sorted(map(repr, last.collect())) == sorted(map(repr, want.collect()))


def test_arrivals_are_all_rows_a_step_late_at_most(spark):
    table = spark.range(1000).withColumn("x", F.col("id") % 7)
    stream = arrivals(table, F.col("id"), F.col("x") == 3, "arrivals")
    got = run_to_table(stream, "append", "arrivals-read")
    assert sorted(r.id for r in got.collect()) == list(range(1000))
    first = {r.step: r.b for r in got.withColumn("step", F.floor(F.col("id") / 200)).where("x <> 3").groupBy("step").agg(F.min("batch_id").alias("b")).collect()}
    assert len(set(first.values())) > 3 and [first[k] for k in sorted(first)] == sorted(first.values())
    assert run_to_table(arrivals(table.limit(0), F.col("id"), F.lit(False), "none"), "append", "none-read").count() == 0
