"""Note mutations: the current notes of an ordered event log, what each event did, deletion, first-wins deduplication.

Events of a key apply in the order of (ts, seq). Operations: replace, append, forget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notes_engine.functions import canonical_tags, in_order, text_or_empty

KEYS = ("project_id", "key")


def fold_notes(events: DataFrame) -> DataFrame:
    """The notes that a log leaves: value, tags, times and position of each key that isn't forgotten.

    A forget ends what was before it. After the last one: the value is the last
    replace and the appends after it, joined by line ends (the first event
    creates, whatever its operation); tags are the union of all; created_at and
    position (seq) are the first event's; updated_at is the last's.

    The last forget and the last replace of each key are aggregated first, on
    the map side, so that values which don't reach the result aren't shuffled,
    and a key with most of the events is a skewed join, not one window.
    """
    at = F.struct("ts", "seq")
    cuts = events.groupBy(*KEYS).agg(F.max(F.when(F.col("op") == "forget", at)).alias("_forget"), F.max(F.when(F.col("op") == "replace", at)).alias("_replace"))
    live = events.where(F.col("op") != "forget").join(cuts, list(KEYS)).where(F.col("_forget").isNull() | (at > F.col("_forget")))
    reaches = F.col("_replace").isNull() | F.coalesce(F.col("_forget") > F.col("_replace"), F.lit(False)) | (at >= F.col("_replace"))
    kept = live.select(
        *KEYS, "ts", "seq", canonical_tags(F.col("tags")).alias("_tags"), F.when(reaches, F.struct("ts", "seq", text_or_empty("value").alias("value"))).alias("_part"),
    )
    folded = kept.groupBy(*KEYS).agg(
        F.collect_list("_part").alias("_parts"), F.collect_set("_tags").alias("_tags"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.min(F.struct("ts", "seq")).alias("_first"),
    )
    return folded.select(
        *KEYS, in_order(F.col("_parts"), "value", "\n").alias("value"), canonical_tags(F.flatten("_tags")).alias("tags"), "created_at", "updated_at", F.col("_first.seq").alias("position"),
    )


def note_actions(events: DataFrame) -> DataFrame:
    """What each event did: action (created, updated, deleted, not_found), the tags passed, and the project's notes after it.

    Windows are cut by day, so that a busy project or key is many partitions;
    what a day starts from comes from the days before, one row each.
    """
    at, day = F.struct("ts", "seq"), F.to_date("ts").alias("_day")
    by_day = events.withColumn("_day", F.to_date("ts"))
    last_op = events.groupBy(*KEYS, day).agg(F.max_by("op", at).alias("_last"))
    before = last_op.withColumn("_before", F.lag("_last").over(Window.partitionBy(*KEYS).orderBy("_day"))).drop("_last")
    within = Window.partitionBy(*KEYS, "_day").orderBy("ts", "seq")
    labelled = by_day.join(before, [*KEYS, "_day"]).withColumn("_previous", F.coalesce(F.lag("op").over(within), F.col("_before")))
    live = F.coalesce(F.col("_previous") != "forget", F.lit(False))
    labelled = labelled.withColumn("_live", live).withColumn(
        "action",
        F.when(F.col("op") == "forget", F.when(F.col("_live"), "deleted").otherwise("not_found")).otherwise(F.when(F.col("_live"), "updated").otherwise("created")),
    ).withColumn("_change", F.when(F.col("action") == "created", 1).when(F.col("action") == "deleted", -1).otherwise(0).cast("long"))
    days = labelled.groupBy("project_id", "_day").agg(F.sum("_change").alias("_sum"))
    start = F.sum("_sum").over(Window.partitionBy("project_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("project_id", "_day", F.coalesce(start, F.lit(0)).alias("_start"))
    running = F.sum("_change").over(Window.partitionBy("project_id", "_day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return labelled.join(days, ["project_id", "_day"]).select(*KEYS, "ts", "seq", "action", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), (F.col("_start") + running).alias("total"))


def dedup_first(notes: DataFrame) -> DataFrame:
    """One note per key: the first by position, chosen before the shuffle."""
    columns = [c for c in notes.columns if c not in KEYS]
    first = notes.groupBy(*KEYS).agg(F.min_by(F.struct(*columns), "position").alias("_note"))
    return first.select(*KEYS, "_note.*").select(notes.columns)


def forget_notes(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """The notes without all rows of the keys (project_id, key)."""
    return notes.join(keys.select(*KEYS), list(KEYS), "left_anti")


def forget_report(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key to forget: deleted or not, the project's notes that remain, and an error where there was none."""
    wanted = keys.select(*KEYS).distinct()
    found = notes.select(*KEYS).join(wanted, list(KEYS), "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    remaining = forget_notes(notes, wanted).groupBy("project_id").agg(F.count(F.lit(1)).alias("_left"))
    return wanted.join(found, list(KEYS), "left").join(remaining, "project_id", "left").select(
        *KEYS, F.col("_n").isNotNull().alias("deleted"), F.coalesce("_left", F.lit(0)).alias("remaining"), F.when(F.col("_n").isNull(), "not found").alias("error"),
    )
