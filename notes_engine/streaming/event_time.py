"""The note fold and the session gate as streams in event time: events come in any order within the watermark's delay.

Both give, once the input is read, what the batch forms give on the same events,
but for those that Spark drops as late (older than the watermark, which follows
the latest event seen by `delay`); the query's progress counts them.

Fold. A key's state is a base, what its final events leave, and the pending
events, which older ones may still precede. After each micro-batch that touches
a key its note is emitted as the two together give it. A timer at the oldest
pending event folds what the watermark has passed into the base, so pending
events span no more than the delay; a key that is forgotten leaves no state.

Gate. A session's days (and projects) are grouped by hash into buckets. State is
each day's first onboarding and the events that were blocked; an earlier
onboarding that comes late opens those behind it, which are emitted again. A timer
at the end of the first day that a bucket holds clears the days that have ended,
so that state holds the days within the delay and no more.

Rows of a key are read chunk by chunk, and lists in state are appended to and
read in parts, so a hot key takes one task's time but not its memory.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notes_engine.operators.gate import EXEMPT, GATED, ONBOARD
from notes_engine.streaming.processors import Chunks, bucket_of, texts_of

NOTE = "value STRING, tags ARRAY<STRING>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, position BIGINT, live BOOLEAN"
EVENT = "op STRING, value STRING, tags ARRAY<STRING>, ts TIMESTAMP_NTZ, seq BIGINT"
NOTE_OUT = f"project_id STRING, key STRING, {NOTE}"
TOOL_EVENT = "tool_name STRING, file_path STRING, ts TIMESTAMP_NTZ, event_id BIGINT"
#: Rows that are handed to state at once.
AT_ONCE = 1000

Note = tuple[str | None, list[str], dt.datetime | None, dt.datetime | None, int | None, bool]
NO_NOTE: Note = (None, [], None, None, None, False)


def fold_on(base: Note, events: Callable[[], Iterator[tuple]]) -> Note:
    """The note that events (op, value, tags, ts, seq), all after what made base and in no order, leave. They are gone through twice."""
    forget = replace = None
    for op, _, _, ts, seq in events():
        if op == "forget":
            forget = max(forget or (ts, seq), (ts, seq))
        elif op == "replace":
            replace = max(replace or (ts, seq), (ts, seq))
    value, tags, created, updated, position, live = base if forget is None else NO_NOTE
    whole = replace is not None and (forget is None or replace > forget)  # the value starts at the last replace
    first = last = None
    parts, given = [], set(tags)
    for op, text, own, ts, seq in events():
        at = ts, seq
        if op == "forget" or (forget is not None and at < forget):
            continue
        first, last = min(first or at, at), max(last or at, at)
        given.update(t for t in own or () if t is not None)
        if not whole or at >= replace:
            parts.append((at, text or ""))
    if first is None:
        return value, sorted(given), created, updated, position, live
    joined = "\n".join(text for _, text in sorted(parts, key=lambda p: p[0]))
    created, position = (created, position) if live else first
    return f"{value}\n{joined}" if live and not whole else joined, sorted(given), created, last[0], position, True


def _rows(chunk: pd.DataFrame, columns: list[str]) -> Iterator[list[tuple]]:
    """A chunk's rows as plain tuples, AT_ONCE at a time."""
    plain = [[_plain(v) for v in chunk[c].tolist()] for c in columns]
    rows = list(zip(*plain, strict=True))
    for at in range(0, len(rows), AT_ONCE):
        yield rows[at : at + AT_ONCE]


def _plain(v: object) -> object:
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if hasattr(v, "__len__"):
        return list(v)
    return None if pd.isna(v) else v


def _with_event_time(events: DataFrame, delay: str) -> DataFrame:
    """events that have a time, under a watermark: one on ts itself must be on a time zone's, so it is on the same reading in UTC, whatever the session's zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return events.where("ts IS NOT NULL").withColumn("_at", F.timestamp_micros(micros)).withWatermark("_at", delay)


def _millis(ts: dt.datetime) -> int:
    """The first millisecond at which a watermark has passed ts."""
    since = ts - dt.datetime(1970, 1, 1)
    return -(-(since // dt.timedelta(microseconds=1)) // 1000)


class PendingFold(StatefulProcessor):
    """Emits a key's note after each micro-batch that touches it; live is false where it is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", NOTE)
        # Of two lists one is in use; what stays pending is moved to the other, in parts.
        self.lists = [handle.getListState(f"pending{k}", EVENT) for k in range(2)]
        self.used = handle.getValueState("used", "used INT")
        self.timer = handle.getValueState("timer", "at BIGINT")

    def _pending(self) -> int:
        return self.used.get()[0] if self.used.exists() else 0

    def _note(self) -> Note:
        if not self.base.exists():
            return NO_NOTE
        value, tags, *rest = self.base.get()
        return (value, list(tags), *rest)

    def _wait(self, at: int) -> None:
        """One timer a key, at the oldest pending event."""
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or at < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        pending, oldest = self.lists[self._pending()], None
        for chunk in rows:
            for part in _rows(chunk, ["op", "value", "tags", "ts", "seq"]):
                pending.appendList(part)
                least = min(r[3] for r in part)
                oldest = least if oldest is None else min(oldest, least)
        self._wait(_millis(oldest))
        value, tags, created, updated, position, live = fold_on(self._note(), pending.get)
        yield pd.DataFrame({
            "project_id": [key[0]], "key": [key[1]], "value": [value], "tags": [tags], "created_at": pd.to_datetime(pd.Series([created])), "updated_at": pd.to_datetime(pd.Series([updated])),
            "position": pd.array([position], "Int64"), "live": [live],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        passed, used = timerValues.getCurrentWatermarkInMs(), self._pending()
        old, new = self.lists[used], self.lists[1 - used]
        note = fold_on(self._note(), lambda: (e for e in old.get() if _millis(e[3]) <= passed))
        oldest, part = None, []
        for e in old.get():
            if _millis(e[3]) > passed:
                oldest = e[3] if oldest is None else min(oldest, e[3])
                part.append(tuple(e))
            if len(part) == AT_ONCE:
                new.appendList(part)
                part = []
        if part:
            new.appendList(part)
        old.clear()
        self.timer.clear()
        self.used.update((1 - used,))
        if note[-1]:
            self.base.update(note)
        else:
            self.base.clear()
        if oldest is not None:
            self._wait(_millis(oldest))
        elif not note[-1]:
            self.used.clear()
        yield from ()

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, *, delay: str) -> DataFrame:
    """A stream of note events (schemas.NOTE_EVENTS), out of order by up to `delay`, into a stream of changed notes: NOTE_OUT. The last row of a key holds."""
    return _with_event_time(events, delay).groupBy("project_id", "key").transformWithStateInPandas(PendingFold(), NOTE_OUT, "Update", "EventTime")


class DayGate(StatefulProcessor):
    """Adds to the events of a bucket of days whether they are open: the day's first onboarding is at or before them."""

    def __init__(self, by: list[str]):
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getMapState("opened", "session_id STRING, day DATE, project_id STRING", "ts TIMESTAMP_NTZ, event_id BIGINT")
        # Of two lists one has rows; what stays blocked is moved to the other, in parts.
        self.lists = [handle.getListState(f"blocked{k}", f"session_id STRING, project_id STRING, {TOOL_EVENT}") for k in range(2)]

    def _blocked(self) -> int:
        return int(self.lists[1].exists())

    def _wait(self, at: int) -> None:
        """One timer a bucket, at the end of the first day that it holds."""
        held = list(self.handle.listTimers())
        if not held or at < held[0]:
            for one in held:
                self.handle.deleteTimer(one)
            self.handle.registerTimer(at)

    def _days(self, sessions: list, ats: list[tuple[dt.datetime, int]], projects: list) -> list[tuple]:
        """The day that each event belongs to, as a key of opened."""
        own = "project_id" in self.by
        return [(s, at[0].date(), p if own else None) for s, at, p in zip(sessions, ats, projects, strict=True)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held = self.opened.getValue if self.opened.exists() else lambda day: None
        before: dict[tuple, tuple | None] = {}  # of days with events that open or are gated
        opened: dict[tuple, tuple | None] = {}
        blocked, first, chunks = self.lists[self._blocked()], None, Chunks(rows)
        for chunk in chunks.first():
            some = chunk[chunk["opens"].astype(bool) | chunk["gated"].astype(bool)]
            ats = _ats(some)
            for day, at, opens in zip(self._days(texts_of(some["session_id"]), ats, texts_of(some["project_id"])), ats, some["opens"].tolist(), strict=True):
                if day not in before:
                    found = held(day)
                    before[day] = opened[day] = None if found is None else tuple(found)
                if opens and (opened[day] is None or at < opened[day]):
                    opened[day] = at
        for chunk in chunks.again():
            ats = _ats(chunk)
            days = self._days(texts_of(chunk["session_id"]), ats, texts_of(chunk["project_id"]))
            chunk = chunk.assign(open=[(since := opened.get(day)) is not None and at >= since for day, at in zip(days, ats, strict=True)])
            for part in _rows(chunk[chunk["gated"].astype(bool) & ~chunk["open"]], ["session_id", "project_id", "tool_name", "file_path", "ts", "event_id"]):
                blocked.appendList(part)
                first = min(r[4] for r in part) if first is None else min(first, min(r[4] for r in part))
            yield chunk[_OUT]
        changed = {day: at for day, at in opened.items() if at != before[day]}
        for day, at in changed.items():
            self.opened.updateValue(day, at)
            first = at[0] if first is None else min(first, at[0])
        if changed:
            part = []
            for e in blocked.get():
                (day,), at = self._days([e[0]], [(e[4], e[5])], [e[1]]), (e[4], e[5])
                if day in changed and changed[day] <= at and (before[day] is None or at < before[day]):
                    part.append((*e, True, True))
                if len(part) == AT_ONCE:
                    yield pd.DataFrame(part, columns=_OUT)
                    part = []
            if part:
                yield pd.DataFrame(part, columns=_OUT)
        if first is not None:
            self._wait(_end_of(first.date()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        passed, used = timerValues.getCurrentWatermarkInMs(), self._blocked()
        old, new = self.lists[used], self.lists[1 - used]
        first, part, gone = None, [], []
        for e in old.get():
            if _end_of(e[4].date()) > passed:
                first = e[4].date() if first is None else min(first, e[4].date())
                part.append(tuple(e))
            if len(part) == AT_ONCE:
                new.appendList(part)
                part = []
        if part:
            new.appendList(part)
        old.clear()
        for day in self.opened.keys():
            if _end_of(day[1]) > passed:
                first = day[1] if first is None else min(first, day[1])
            else:
                gone.append(tuple(day))
        for day in gone:
            self.opened.removeKey(day)
        if first is not None:
            self.handle.registerTimer(_end_of(first))
        yield from ()

    def close(self) -> None:
        pass


def _end_of(day: dt.date) -> int:
    return _millis(dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1))


_OUT = ["session_id", "project_id", "tool_name", "file_path", "ts", "event_id", "gated", "open"]


def _ats(chunk: pd.DataFrame) -> list[tuple[dt.datetime, int]]:
    return list(zip(chunk["ts"].to_numpy("datetime64[us]").tolist(), chunk["event_id"].tolist(), strict=True))


def gate_stream(events: DataFrame, marked: DataFrame, *, delay: str, per_project: bool = False, onboard_tool: str = ONBOARD) -> DataFrame:
    """A stream of tool events (schemas.TOOL_EVENTS), out of order by up to `delay`, with decision and reason; the last row of an event holds.

    marked: a static table of (project_id). per_project: onboarding opens its own
    project alone. Events without a time are left out; events without a session
    share one.
    """
    flags = marked.select("project_id", F.lit(True).alias("_marked"))
    known = _with_event_time(events, delay).join(flags, "project_id", "left")
    own, exempt = F.coalesce("_marked", F.lit(False)), F.lit(False)
    for part in EXEMPT:
        exempt = exempt | F.coalesce(F.col("file_path"), F.lit("")).contains(part)
    gated = own & F.coalesce(F.col("tool_name").isin(*GATED), F.lit(False)) & ~exempt
    opens = own & F.coalesce(F.col("tool_name") == onboard_tool, F.lit(False))
    rows = known.select("session_id", "project_id", "tool_name", "file_path", "ts", "event_id", "_at", F.to_date("ts").alias("day"), gated.alias("gated"), opens.alias("opens"))
    by = ["session_id", "day", *["project_id"] * per_project]
    schema = f"session_id STRING, project_id STRING, {TOOL_EVENT}, gated BOOLEAN, open BOOLEAN"
    seen = rows.withColumn("bucket", bucket_of(*by)).groupBy("bucket").transformWithStateInPandas(DayGate(by), schema, "Update", "EventTime")
    blocked = F.col("gated") & ~F.col("open")
    reason = F.when(F.col("tool_name").isNull(), "malformed").when(blocked, "onboard first")
    return seen.select(*_OUT[:-2], F.when(blocked, "block").otherwise("allow").alias("decision"), reason.alias("reason"))
