"""Session gate: whether tool events may run, by what the session did earlier on the same day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tools that change files, and paths that they may change at any time.
GATED = ("Edit", "Write")
EXEMPT = (".claude/", ".claude\\")
ONBOARD = "onboard"


def marked_projects(docs: DataFrame) -> DataFrame:
    """Projects that have settings or a map; the gate is for these alone."""
    return docs.where(F.col("kind").isin("settings", "map")).select("project_id").distinct()


def decide(tool: Column, path: Column, marked: Column, onboarded: Column, malformed: Column) -> tuple[Column, Column]:
    """(decision, reason). What can't be read, and what is no change of a marked project, is allowed."""
    exempt = F.lit(False)
    for part in EXEMPT:
        exempt = exempt | F.coalesce(path, F.lit("")).contains(part)
    blocked = marked & F.coalesce(tool, F.lit("")).isin(*GATED) & ~exempt & ~onboarded
    decision = F.when(malformed, "allow").when(blocked, "block").otherwise("allow")
    return decision, F.when(malformed, "malformed").when(blocked, "onboard first")


def gate_events(events: DataFrame, marked: DataFrame, *, per_project: bool = False, onboard_tool: str = ONBOARD) -> DataFrame:
    """Events with decision and reason. An onboarding event opens the rest of its session's day; with per_project, for its own project alone.

    Only onboarding in marked projects counts. A malformed event has no tool_name.
    """
    flags = marked.select("project_id", F.lit(True).alias("_marked"))
    known = events.join(flags, "project_id", "left").withColumn("_marked", F.coalesce("_marked", F.lit(False))).withColumn("_day", F.to_date("ts"))
    by = ["session_id", "_day", *["project_id"] * per_project]
    so_far = Window.partitionBy(*by).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    onboarded = F.coalesce(F.max(F.col("_marked") & (F.col("tool_name") == onboard_tool)).over(so_far), F.lit(False))
    seen = known.withColumn("_onboarded", onboarded)
    decision, reason = decide(F.col("tool_name"), F.col("file_path"), F.col("_marked"), F.col("_onboarded"), F.col("tool_name").isNull())
    return seen.select(*events.columns, decision.alias("decision"), reason.alias("reason"))
