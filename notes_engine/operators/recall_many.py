"""Recall for large tables of requests: all searches of a project in one pass over its notes.

Key requests are an equi-join. The others are made distinct searches first (equal
ones share their result). A project's searches and notes meet in one task, or in
several where the project is large; the searches come first and make an
Aho-Corasick automaton, then the notes pass by, and each search keeps the most
recent ones that it finds, as many as its limit. So notes are sent and read once,
whatever the number of requests, and what leaves a task is bounded by the limits.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notes_engine.functions import canonical_tags
from notes_engine.operators.recall import DEFAULT_LIMIT, by_recency

#: Notes of a project that one task goes through at least, before the project is split.
SLICE_NOTES = 20_000
_SENT = ("key", "value", "tags", "updated_at", "position")
_SEARCH = ("project_id", "query", "any_tags", "top")


class Searches:
    """A project's searches, and the best notes that each has found so far."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.tags: list[frozenset[str]] = []
        self.limits: list[int] = []
        self.found: list[list[tuple]] = []
        self.all: list[int] = []
        self.by_tag: dict[str, list[int]] = defaultdict(list)
        self.by_text: dict[str, list[int]] = defaultdict(list)
        self.automaton = None

    def add(self, name: str, text: str, tags: list[str], limit: int) -> None:
        number = len(self.names)
        self.names.append(name)
        self.tags.append(frozenset(tags))
        self.limits.append(limit)
        self.found.append([])
        if text:
            self.by_text[text].append(number)
        elif tags:
            for t in tags:
                self.by_tag[t].append(number)
        else:
            self.all.append(number)

    def _with_text(self, text: str) -> set[str]:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for word in self.by_text:
                self.automaton.add_word(word, word)
            self.automaton.make_automaton()
        return {word for _, word in self.automaton.iter(text)}

    def see(self, key: str | None, value: str | None, tags: list[str | None] | None, updated: object, position: int) -> None:
        """A note passes by."""
        own = {t for t in tags or () if t is not None}
        hits = set(self.all)
        for t in own:
            hits.update(self.by_tag.get(t, ()))
        if self.by_text:
            for word in self._with_text((key or "").lower()) | self._with_text((value or "").lower()):
                hits.update(n for n in self.by_text[word] if not self.tags[n] or self.tags[n] & own)
        if not hits:
            return
        # Missing times last, ties by position.
        note = (updated is not None, updated if updated is not None else 0, -position, key is not None, key or "")
        for n in hits:
            best = self.found[n]
            if len(best) < self.limits[n]:
                heapq.heappush(best, note)
            elif best and note[:3] > best[0][:3]:
                heapq.heapreplace(best, note)

    def results(self) -> Iterator[tuple]:
        for name, best in zip(self.names, self.found, strict=True):
            for timed, updated, place, keyed, key in best:
                yield name, key if keyed else None, updated if timed else None, -place


def _passed(batches: Iterator[pa.RecordBatch], at_once: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches sorted by project, slice and kind (searches before notes); see _candidates()."""
    schema = pa.schema([("search", pa.string()), ("key", pa.string()), ("updated_at", pa.timestamp("us")), ("position", pa.int64())])
    group, searches, held = None, Searches(), []

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for whole in batches:
        for begin in range(0, whole.num_rows, at_once):
            columns = [c.to_pylist() for c in whole.slice(begin, at_once).columns]
            for project, part, kind, key, value, tags, updated, position in zip(*columns, strict=True):
                if (project, part) != group:
                    held += searches.results()
                    group, searches = (project, part), Searches()
                if kind == 0:
                    searches.add(key, value or "", tags or [], position)
                elif searches.names:
                    searches.see(key, value, tags, updated, position)
            if len(held) >= at_once:
                yield told(held)
                held = []
    held += searches.results()
    if held:
        yield told(held)


def _candidates(notes: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, key, updated_at, position): of each search and slice of a project, the most recent notes found, as many as its limit.

    A project is split into no more slices than there are shuffle partitions: a
    search goes to as many tasks as can work on it at once, and a slice's notes
    pass by one by one. Rows of both sides are sent with one set of columns: a
    search's name, text, tags and limit stand in key, value, tags and position.
    """
    partitions = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(SLICE_NOTES, notes.count() // partitions)
    large = notes.groupBy("project_id").count().where(F.col("count") > most).select("project_id", (F.floor(F.col("count") / most) + 1).cast("int").alias("_parts"))
    large = F.broadcast(large)  # fewer rows than partitions
    parts = F.coalesce("_parts", F.lit(1))
    own = notes.join(large, "project_id", "left").select("project_id", F.pmod(F.xxhash64("key", "position"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), *_SENT)
    asked = searches.join(large, "project_id", "left").select(
        "project_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), F.col("search").alias("key"), F.col("query").alias("value"), F.col("any_tags").alias("tags"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.col("top").cast("long").alias("position"),
    )
    dealt = asked.unionByName(own).repartition("project_id", "part").sortWithinPartitions("project_id", "part", "kind")
    return dealt.mapInArrow(_passed, "search string, key string, updated_at timestamp_ntz, position long")


def found_places(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, rank, project_id, key, position) of what each request finds; see recall_many()."""
    asked = requests.withColumn("_key", F.coalesce("key", F.lit("")))
    by_key = asked.where("_key <> ''").select("request_id", "project_id", F.col("_key").alias("key"))
    first = notes.select("project_id", "key", "position").join(by_key.select("project_id", "key").distinct(), ["project_id", "key"], "left_semi").groupBy("project_id", "key").agg(F.min("position").alias("position"))
    columns = ["request_id", "rank", "project_id", "key", "position"]
    found_by_key = by_key.join(first, ["project_id", "key"]).withColumn("rank", F.lit(1)).select(columns)

    tags = canonical_tags(F.col("tags"))
    free = asked.where("_key = '' AND project_id IS NOT NULL").select("request_id", "project_id", F.lower(F.coalesce("query", F.lit(""))).alias("query"), tags.alias("any_tags"), F.coalesce("max_rows", F.lit(DEFAULT_LIMIT)).alias("top"))
    free = free.withColumn("search", F.md5(F.to_json(F.struct(*_SEARCH))))
    searches = free.where("top > 0").select("search", *_SEARCH).distinct()
    kept = _candidates(notes, searches).join(searches.select("search", "project_id", "top"), "search")
    highest = searches.agg(F.coalesce(F.max("top"), F.lit(0))).first()[0]
    place = F.row_number().over(Window.partitionBy("search").orderBy(*by_recency()))
    # The constant lets each task cut its rows before they are sent; the search's own limit follows.
    ranked = kept.withColumn("rank", place).where(F.col("rank") <= highest).where(F.col("rank") <= F.col("top"))
    return free.select("request_id", "search").join(ranked, "search").select(columns).unionByName(found_by_key)


def recall_many(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, rank, the note's columns): what recall_batch() gives, for any number of requests.

    requests: (request_id, project_id, key, query, tags, max_rows). A key, where
    one is given, decides alone; else query and tags, as far as they are given;
    without either all notes are found. A null limit is the default, and one
    under 0 finds nothing. Null projects match none. Repeated requests: each has
    its rows. Notes are told apart by project, key and position. Nulls in notes:
    as empty; missing times come last. Empty tables: no rows.
    """
    found = found_places(notes, requests)
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("key", "position")]
    joined = notes.alias("n").join(found.alias("f"), (F.col("f.project_id") == F.col("n.project_id")) & same[0] & same[1])
    return joined.select("f.request_id", "f.rank", *[f"n.{c}" for c in notes.columns])
