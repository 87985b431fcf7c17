"""Stateful processors: the current note of each key, and each session's last day of onboarding.

Both take a key's events in the order of time within a micro-batch, and expect
micro-batches in that order; events older than what a key has seen are late:
they don't change it, and the fold counts them. Gate state holds one date a
session; fold state holds the live notes.

Keys are grouped by BUCKETS hashes, as each group that Spark hands over costs
milliseconds, of which a key's own share is then its entry in the bucket's state.
Spark hands over a bucket's rows in chunks without order. Both go through the
chunks twice, once for what decides (the last forget and replace; the first
onboarding of each day) and once for the rest, with one chunk in memory, beside
the bucket's notes that the micro-batch touches; chunks wait in a temporary file
of the task in between.
"""

from __future__ import annotations

import datetime as dt
import pickle
import tempfile
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notes_engine.operators.gate import ONBOARD, decide

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTE_STATE = "value STRING, tags ARRAY<STRING>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, position BIGINT, live BOOLEAN, late BIGINT, ts TIMESTAMP_NTZ, seq BIGINT"
#: Groups that keys are dealt into by hash. State is kept by them, so a stream must go on with the number it began with.
BUCKETS = 1024
#: Notes that are emitted at once.
AT_ONCE = 1000
NOTE_OUT = "project_id STRING, key STRING, value STRING, tags ARRAY<STRING>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, position BIGINT, live BOOLEAN, late BIGINT"


class Chunks:
    """A key's chunks of rows for two passes: the first one's chunks, but for the very first, are kept in a temporary file for the second."""

    def __init__(self, rows: Iterator[pd.DataFrame]):
        self.rows, self.head, self.file = rows, None, None

    def first(self) -> Iterator[pd.DataFrame]:
        for chunk in self.rows:
            if self.head is None:
                self.head = chunk
            else:
                self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
                pickle.dump(chunk, self.file, pickle.HIGHEST_PROTOCOL)
            yield chunk

    def again(self) -> Iterator[pd.DataFrame]:
        if self.head is None:
            return
        head, self.head = self.head, None
        yield head
        del head
        if self.file:
            with self.file as file:
                end = file.tell()
                file.seek(0)
                while file.tell() < end:
                    yield pickle.load(file)  # noqa: S301


def bucket_of(*columns: str) -> Column:
    """The bucket that keys fall into."""
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).alias("bucket")


def texts_of(column: pd.Series) -> list[str | None]:
    return [v if isinstance(v, str) else None for v in column.tolist()]


def _plain(t: object) -> dt.datetime | None:
    return None if t is None else pd.Timestamp(t).to_pydatetime()


class _Folding:
    """A key's note, and a micro-batch's events of it: see() each of them, then add() each."""

    __slots__ = ("value", "tags", "created", "updated", "position", "live", "late", "start", "newest", "forget", "replace", "whole", "first", "last", "parts", "given")

    def __init__(self, state: tuple | None):
        self.value, self.tags, self.created, self.updated, self.position, self.live, self.late, ts, seq = state or (None, [], None, None, None, False, 0, None, None)
        self.start = None if ts is None else (pd.Timestamp(ts), seq)
        self.newest = self.forget = self.replace = self.given = None

    def see(self, at: tuple, op: str) -> None:
        if self.start is not None and at < self.start:
            self.late += 1
            return
        self.newest = at if self.newest is None else max(self.newest, at)
        if op == "forget":
            self.forget = at if self.forget is None else max(self.forget, at)
        elif op == "replace":
            self.replace = at if self.replace is None else max(self.replace, at)

    def _seen(self) -> None:
        """What all events that were seen decide."""
        if self.forget is not None:
            self.value, self.tags, self.created, self.updated, self.position, self.live = None, [], None, None, None, False
        self.whole = self.replace is not None and (self.forget is None or self.replace > self.forget)  # the value starts at the last replace
        self.first, self.last, self.parts, self.given = None, None, [], set(self.tags)

    def add(self, at: tuple, op: str, value: object, tags: object) -> None:
        if self.given is None:
            self._seen()
        if op == "forget" or (self.start is not None and at < self.start) or (self.forget is not None and at < self.forget):
            return
        self.first = at if self.first is None else min(self.first, at)
        self.last = at if self.last is None else max(self.last, at)
        self.given.update(() if tags is None else (t for t in tags if t is not None))
        if not self.whole or at >= self.replace:
            self.parts.append((*at, value if isinstance(value, str) else ""))

    def state(self) -> tuple:
        if self.first is not None:
            joined = "\n".join(p[2] for p in sorted(self.parts, key=lambda p: p[:2]))
            self.value = f"{self.value}\n{joined}" if self.live and not self.whole else joined
            self.created, self.position = (self.created, self.position) if self.live else self.first
            self.tags, self.updated, self.live = sorted(self.given), self.last[0], True
        ts, seq = self.newest or self.start or (None, None)
        return self.value, list(self.tags), _plain(self.created), _plain(self.updated), self.position, self.live, self.late, _plain(ts), seq


class NoteFold(StatefulProcessor):
    """Emits a key's note after each micro-batch that touches it; live is false once it is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.note = handle.getValueState("note", NOTE_STATE)

    def held(self) -> Callable[[tuple], tuple | None]:
        return lambda key: self.note.get() if self.note.exists() else None

    def hold(self, key: tuple, state: tuple) -> None:
        self.note.update(state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        chunks, held = Chunks(rows), self.held()
        notes: dict[tuple, _Folding] = {}
        for chunk in chunks.first():
            for name, t, n, op in zip(_names(chunk), chunk["ts"], chunk["seq"].tolist(), chunk["op"].tolist(), strict=True):
                note = notes.get(name)
                if note is None:
                    note = notes[name] = _Folding(held(name))
                note.see((t, n), op)
        for chunk in chunks.again():
            for name, t, n, *told in zip(_names(chunk), chunk["ts"], chunk["seq"].tolist(), chunk["op"].tolist(), chunk["value"].tolist(), chunk["tags"].tolist(), strict=True):
                notes[name].add((t, n), *told)
        for part in batched(notes, AT_ONCE):
            states = [notes.pop(name).state() for name in part]
            for name, state in zip(part, states, strict=True):
                self.hold(name, state)
            value, tags, created, updated, position, live, late = list(zip(*states, strict=True))[:7]
            times = {"created_at": np.array(created, "datetime64[us]"), "updated_at": np.array(updated, "datetime64[us]")}
            yield pd.DataFrame({"project_id": [p for p, _ in part], "key": [k for _, k in part], "value": value, "tags": tags, **times, "position": pd.array(position, "Int64"), "live": live, "late": late})

    def close(self) -> None:
        pass


def _names(chunk: pd.DataFrame) -> Iterator[tuple]:
    return zip(texts_of(chunk["project_id"]), texts_of(chunk["key"]), strict=True)


class NoteFolds(NoteFold):
    """NoteFold for a bucket of keys: a note is one entry of its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.notes = handle.getMapState("notes", "project_id STRING, key STRING", NOTE_STATE)

    def held(self) -> Callable[[tuple], tuple | None]:
        return self.notes.getValue if self.notes.exists() else lambda key: None

    def hold(self, key: tuple, state: tuple) -> None:
        self.notes.updateValue(key, state)


def fold_stream(events: DataFrame) -> DataFrame:
    """A stream of note events into a stream of changed notes."""
    return events.withColumn("bucket", bucket_of("project_id", "key")).groupBy("bucket").transformWithStateInPandas(NoteFolds(), NOTE_OUT, "Update", "None")


class OnboardedDay(StatefulProcessor):
    """Adds to a session's events whether it has onboarded that day."""

    def __init__(self, onboard_tool: str):
        self.onboard_tool = onboard_tool

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day DATE")

    def held(self) -> Callable[[str | None], tuple | None]:
        return lambda session: self.last.get() if self.last.exists() else None

    def hold(self, session: str | None, day: dt.date) -> None:
        self.last.update((day,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        chunks, held = Chunks(rows), self.held()
        last: dict[str | None, dt.date | None] = {}
        opened: dict[tuple, tuple] = {}  # the first onboarding of each session's day
        for chunk in chunks.first():
            for session in set(texts_of(chunk["session_id"])) - last.keys():
                last[session] = (held(session) or (None,))[0]
            found = chunk[chunk["marked"].astype(bool) & (chunk["tool_name"] == self.onboard_tool)]
            for session, *at in zip(texts_of(found["session_id"]), found["ts"], found["event_id"], strict=True):
                day = session, at[0].date()
                if last[session] is None or day[1] > last[session]:
                    opened[day] = min(opened.get(day, at), at)
        for chunk in chunks.again():
            times = zip(texts_of(chunk["session_id"]), chunk["ts"], chunk["event_id"], strict=True)
            seen = [(day := at[0].date()) == last[session] or ((session, day) in opened and at >= opened[session, day]) for session, *at in times]
            yield chunk[[c for c in chunk.columns if c != "bucket"]].assign(onboarded=seen)
        newest: dict[str | None, dt.date] = {}
        for session, day in opened:
            newest[session] = max(newest.get(session, day), day)
        for session, day in newest.items():
            self.hold(session, day)

    def close(self) -> None:
        pass


class OnboardedDays(OnboardedDay):
    """OnboardedDay for a bucket of sessions: a session's day is one entry of its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "session_id STRING", "day DATE")

    def held(self) -> Callable[[str | None], tuple | None]:
        return (lambda session: self.days.getValue((session,))) if self.days.exists() else lambda session: None

    def hold(self, session: str | None, day: dt.date) -> None:
        self.days.updateValue((session,), (day,))


def gate_stream(events: DataFrame, marked: DataFrame, *, onboard_tool: str = ONBOARD) -> DataFrame:
    """A stream of tool events with decision and reason; marked is a static table of (project_id)."""
    flags = marked.select("project_id", F.lit(True).alias("marked"))
    known = events.join(flags, "project_id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    schema = "session_id STRING, project_id STRING, tool_name STRING, file_path STRING, ts TIMESTAMP_NTZ, event_id BIGINT, marked BOOLEAN, onboarded BOOLEAN"
    columns = [f.split()[0] for f in schema.split(", ")[:-1]]
    seen = known.select(*columns, bucket_of("session_id")).groupBy("bucket").transformWithStateInPandas(OnboardedDays(onboard_tool), schema, "Append", "None")
    decision, reason = decide(F.col("tool_name"), F.col("file_path"), F.col("marked"), F.col("onboarded"), F.col("tool_name").isNull())
    return seen.select(*columns[:-1], decision.alias("decision"), reason.alias("reason"))
