"""Context assembly: which projects are set up, default documents, note summaries, and one text per project under a character budget."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notes_engine.functions import in_order, text_or_empty

DEFAULT_BUDGET = 50_000
SUMMARY_NOTES = 10
#: What stands between sections, what a cut text ends in, and headings by kind.
BETWEEN = "\n\n---\n\n"
CUT_SUFFIX = "\n\n[TRUNCATED - context exceeds limit]"
HEADINGS = {"map": "# Project Map\n\n", "decisions": "# Decisions\n\n", "task": "# Current Task\n\n"}
SUMMARY = "summary"

#: What a project without a document of a kind gets; callers pass their own.
DEFAULT_DOCS = {
    "map": "Describe the project: its purpose, where it starts, and what a newcomer must know.\n",
    "decisions": "List decisions by date, each with its reason.\n",
    "task": "State the goal, what is done, and what comes next.\n",
}


def project_registry(docs: DataFrame, settings_kind: str = "settings") -> DataFrame:
    """(project_id, initialised): whether a settings document is there; with the error of those without."""
    flags = docs.groupBy("project_id").agg(F.max(F.col("kind").eqNullSafe(settings_kind)).alias("initialised"))
    return flags.withColumn("error", F.when(~F.col("initialised"), "not initialised"))


def fill_defaults(docs: DataFrame, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """(project_id, kind, body, filled): each project's document of each kind of defaults, the default where there is none. Nothing is overwritten.

    One row per project and kind is made before the shuffle; the defaults are a handful of literals.
    """
    defaults = dict(DEFAULT_DOCS if defaults is None else defaults)
    own = docs.groupBy("project_id").agg(*[F.first(F.when(F.col("kind") == k, F.col("body")), ignorenulls=True).alias(f"_{i}") for i, k in enumerate(defaults)])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(f"_{i}", F.lit(v)).alias("body"), F.col(f"_{i}").isNull().alias("filled")) for i, (k, v) in enumerate(defaults.items())])
    return own.select("project_id", F.explode(rows).alias("_r")).select("project_id", "_r.*")


def initialise(projects: DataFrame, docs: DataFrame, created_at: dt.datetime, defaults: Mapping[str, str] | None = None, *, version: str = "4.0", settings_kind: str = "settings") -> DataFrame:
    """(project_id, kind, body): the documents that projects lack, to be appended to docs; what is there is neither read nor written again.

    Every kind of defaults, and settings as a JSON object with project_name (the
    last part of the project's path), version and created_at. projects:
    (project_id), with or without documents. A document that is there with an
    empty or null body counts as there. Repeated projects: once. Null projects:
    none. Running it again adds nothing. Only names of documents are sent.
    """
    defaults = dict(DEFAULT_DOCS if defaults is None else defaults)
    name = F.element_at(F.split("project_id", "/"), -1)
    settings = F.to_json(F.struct(name.alias("project_name"), F.lit(version).alias("version"), F.lit(created_at.isoformat()).alias("created_at")))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("body")) for k, v in defaults.items()], F.struct(F.lit(settings_kind).alias("kind"), settings.alias("body")))
    wanted = projects.where("project_id IS NOT NULL").select("project_id").distinct().select("project_id", F.explode(rows).alias("_r")).select("project_id", "_r.*")
    return wanted.join(docs.select("project_id", "kind"), ["project_id", "kind"], "left_anti")


def note_summary(notes: DataFrame, first: int = SUMMARY_NOTES) -> DataFrame:
    """(project_id, summary, n_notes): how many notes, the first ones by position with their tags, and how many more."""
    total = notes.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_notes"))
    tags = F.array_join("tags", ", ")
    line = F.concat(F.lit("- **"), F.coalesce("key", F.lit("unknown")), F.lit("**"), F.when(F.coalesce(F.length(tags), F.lit(0)) > 0, F.concat(F.lit(" ["), tags, F.lit("]"))).otherwise(""), F.lit("\n"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("position"))
    top = notes.withColumn("_place", place).where(F.col("_place") <= first).groupBy("project_id").agg(F.collect_list(F.struct("_place", line.alias("line"))).alias("_lines"))
    more = F.when(F.col("n_notes") > first, F.concat(F.lit("- ... and "), (F.col("n_notes") - first).cast("string"), F.lit(" more\n"))).otherwise("")
    head = F.concat(F.lit("\n\n## Stored Memories ("), F.col("n_notes").cast("string"), F.lit(" total)\n"))
    return top.join(total, "project_id").select("project_id", F.concat(head, in_order(F.col("_lines"), "line", ""), more).alias("summary"), "n_notes")


def sections(docs: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(project_id, place, kind, section): documents under their headings in a fixed order, the summary last; empty ones are left out."""
    heading = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    place = F.create_map(*[F.lit(x) for kv in zip(HEADINGS, range(len(HEADINGS)), strict=True) for x in kv])
    rows = docs.where(F.col("kind").isin(*HEADINGS) & (F.length("body") > 0)).select("project_id", place[F.col("kind")].alias("place"), "kind", F.concat(heading[F.col("kind")], "body").alias("section"))
    if summaries is None:
        return rows
    return rows.unionByName(summaries.where(F.length("summary") > 0).select("project_id", F.lit(len(HEADINGS)).alias("place"), F.lit(SUMMARY).alias("kind"), F.col("summary").alias("section")))


def assemble(parts: DataFrame, budget: int = DEFAULT_BUDGET, between: str = BETWEEN, suffix: str = CUT_SUFFIX) -> DataFrame:
    """(project_id, context, context_size, truncated) from (project_id, place, section).

    Sections whose separator starts beyond the budget are dropped before they are
    collected; whether the text was cut comes from the sum of all lengths.
    """
    order = Window.partitionBy("project_id").orderBy("place")
    until = F.sum(F.length("section") + len(between)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("_end", until - len(between)).withColumn("_start", F.col("_end") - F.length("section"))
    grouped = placed.groupBy("project_id").agg(F.max("_end").alias("_full"), F.collect_list(F.when(F.col("_start") - len(between) < budget, F.struct("place", "section"))).alias("_parts"))
    text, cut = in_order(F.col("_parts"), "section", between), F.col("_full") > budget
    context = F.when(cut, F.concat(F.substring(text, 1, budget), F.lit(suffix))).otherwise(text)
    return grouped.select("project_id", context.alias("context"), F.length(context).cast("long").alias("context_size"), cut.alias("truncated"))


def contexts(docs: DataFrame, notes: DataFrame | None = None, settings: DataFrame | None = None, *, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """One row per project with documents, notes or settings: names, context, and which parts were found.

    settings: (project_id, project_name, version). memories_found is true when there are notes.
    """
    summaries = None if notes is None else note_summary(notes)
    parts = sections(docs, summaries)
    found = parts.groupBy("project_id").agg(*[F.max(F.col("kind") == k).alias(f"{k}_found") for k in HEADINGS], F.max(F.col("kind") == SUMMARY).alias("memories_found"))
    out = project_registry(docs).join(assemble(parts, budget), "project_id", "full_outer").join(found, "project_id", "left")
    if settings is not None:
        out = out.join(settings, "project_id", "left")
    name = F.element_at(F.split("project_id", "/"), -1)
    told: Column = F.coalesce("project_name", name) if settings is not None else name
    version = F.coalesce("version", F.lit("4.0")) if settings is not None else F.lit("4.0")
    flags = [F.coalesce(f"{k}_found", F.lit(False)).alias(f"{k}_found") for k in (*HEADINGS, "memories")]
    return out.select(
        "project_id", F.coalesce("initialised", F.lit(False)).alias("initialised"), told.alias("project_name"), version.alias("version"), text_or_empty("context").alias("context"),
        F.coalesce("context_size", F.lit(0)).alias("context_size"), F.coalesce("truncated", F.lit(False)).alias("truncated"), *flags,
    )
