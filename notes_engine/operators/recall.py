"""Recall: key lookup, text and tag filters, recency order, limits and counts; for one project, for all, or for a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notes_engine.functions import any_tag, contains_text

DEFAULT_LIMIT = 10


def checked_limit(limit: float) -> int:
    """An integer of 0 or more; 10.0 is one."""
    if isinstance(limit, bool) or int(limit) != limit or limit < 0:
        raise ValueError(f"limit must be an integer of 0 or more: {limit!r}")
    return int(limit)


def by_recency() -> tuple[Column, Column]:
    """Latest first, missing times last, ties as they were stored."""
    return F.desc_nulls_last("updated_at"), F.asc("position")


def recall_key(notes: DataFrame, project_id: str, key: str) -> DataFrame:
    """The first note with the key, or none; overrides all other filters."""
    return notes.where((F.col("project_id") == project_id) & (F.col("key") == key)).orderBy("position").limit(1)


def search(notes: DataFrame, query: str | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """Notes that have one of the tags, and the query in their key or value. An empty filter is none."""
    if tags:
        notes = notes.where(any_tag(F.col("tags"), F.array(*[F.lit(t) for t in tags])))
    if query:
        notes = notes.where(contains_text(F.lit(query), F.col("key"), F.col("value")))
    return notes


def recall(notes: DataFrame, project_id: str, *, query: str | None = None, tags: Sequence[str] | None = None, limit: float = DEFAULT_LIMIT) -> DataFrame:
    """One project's notes that pass the filters, most recent first."""
    return search(notes.where(F.col("project_id") == project_id), query, tags).orderBy(*by_recency()).limit(checked_limit(limit))


def recall_per_project(notes: DataFrame, *, query: str | None = None, tags: Sequence[str] | None = None, limit: float = DEFAULT_LIMIT) -> DataFrame:
    """The same for every project at once, with rank; each task keeps its first rows of a project before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(*by_recency()))
    return search(notes, query, tags).withColumn("rank", rank).where(F.col("rank") <= checked_limit(limit))


def recall_counts(notes: DataFrame, *, query: str | None = None, tags: Sequence[str] | None = None, limit: float = DEFAULT_LIMIT) -> DataFrame:
    """For each project: hits (after the limit), all its notes, and a message where there are no hits."""
    top = checked_limit(limit)
    hit = F.lit(True)
    if tags:
        hit = hit & any_tag(F.col("tags"), F.array(*[F.lit(t) for t in tags]))
    if query:
        hit = hit & contains_text(F.lit(query), F.col("key"), F.col("value"))
    counts = notes.groupBy("project_id").agg(F.count(F.when(hit, 1)).alias("_hits"), F.count(F.lit(1)).alias("total"))
    return counts.select("project_id", F.least("_hits", F.lit(top)).alias("hits"), "total", F.when(F.col("_hits") == 0, "no match").alias("message"))


def _matching(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Pairs of a request and a note that it finds. Which side is sent where is left to sizes that Spark knows."""
    r, n = requests.alias("r"), notes.alias("n")
    by_key = F.col("r.key").isNotNull() & (F.col("r.key") != "")
    no_tags = F.coalesce(F.size("r.tags"), F.lit(0)) <= 0
    no_query = F.coalesce(F.col("r.query"), F.lit("")) == ""
    free = (no_tags | any_tag(F.col("n.tags"), F.col("r.tags"))) & (no_query | contains_text(F.col("r.query"), F.col("n.key"), F.col("n.value")))
    found = F.when(by_key, F.col("r.key") == F.col("n.key")).otherwise(free)
    limit = F.when(by_key, 1).otherwise(F.coalesce("r.max_rows", F.lit(DEFAULT_LIMIT)))
    return n.join(r, (F.col("r.project_id") == F.col("n.project_id")) & found).select("r.request_id", limit.alias("_limit"), by_key.alias("_by_key"), *[f"n.{c}" for c in notes.columns])


def recall_batch(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """The notes that each request finds, ranked: by key the first stored, else by recency, up to its limit."""
    order = [F.when(~F.col("_by_key"), F.col("updated_at")).desc_nulls_last(), F.asc("position")]
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return _matching(notes, requests).withColumn("rank", rank).where(F.col("rank") <= F.col("_limit")).drop("_limit", "_by_key")


def recall_replies(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: hits after its limit, the project's notes, and a message: empty store, or nothing found."""
    hits = _matching(notes, requests).groupBy("request_id").agg(F.least(F.count(F.lit(1)), F.first("_limit").cast("long")).alias("hits"))
    totals = notes.join(requests.select("project_id").distinct(), "project_id", "left_semi").groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    replies = requests.select("request_id", "project_id", "key").join(hits, "request_id", "left").join(totals, "project_id", "left")
    hits, total = F.coalesce("hits", F.lit(0)), F.coalesce("total", F.lit(0))
    message = F.when(total == 0, "no notes stored").when(hits == 0, F.when(F.coalesce(F.col("key"), F.lit("")) != "", F.concat(F.lit("no note with key "), "key")).otherwise("no match"))
    return replies.select("request_id", "project_id", hits.alias("hits"), total.alias("total"), message.alias("message"))
