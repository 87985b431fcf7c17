"""Request logs: (request_id, tool, arguments as JSON) into one table per tool with defaults, and dead letters. The same for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By tool: its fields, their types, required ones, and defaults.
TOOLS: dict[str, dict[str, tuple[str, bool, object]]] = {
    "onboard": {
        "project_id": ("string", True, None), "init_if_missing": ("boolean", False, False),
        "include_notes_summary": ("boolean", False, True), "max_context_chars": ("double", False, 50_000.0),
    },
    "remember": {
        "project_id": ("string", True, None), "key": ("string", True, None), "value": ("string", True, None),
        "tags": ("array<string>", False, None), "append": ("boolean", False, False),
    },
    "recall": {
        "project_id": ("string", True, None), "key": ("string", False, None), "query": ("string", False, None),
        "tags": ("array<string>", False, None), "limit": ("double", False, 10.0),
    },
    "checkpoint": {
        "project_id": ("string", True, None), "action": ("string", False, "create"), "message": ("string", False, None),
        "checkpoint_id": ("string", False, None), "include_untracked": ("boolean", False, True), "dry_run": ("boolean", False, False),
    },
}
COUNTS = ("max_context_chars", "limit")
ACTIONS = ("create", "list", "rollback")


def _schema(tool: str) -> str:
    return ", ".join(f"`{name}` {kind}" for name, (kind, _, _) in TOOLS[tool].items())


def reasons(requests: DataFrame) -> DataFrame:
    """requests with reason: null where the request can be served, else the first of unknown tool, unreadable arguments, a missing field, a bad value."""
    reason: Column = F.when(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)), "unknown tool")
    for tool, fields in TOOLS.items():
        parsed = F.from_json("arguments", f"{_schema(tool)}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        own = F.col("tool") == tool
        reason = reason.when(own & (F.col("arguments").isNull() | parsed["_bad"].isNotNull()), "unreadable arguments")
        for name, (_, required, _) in fields.items():
            if required:
                reason = reason.when(own & parsed[name].isNull(), f"missing {name}")
            if name in COUNTS:
                reason = reason.when(own & ((parsed[name] < 0) | (parsed[name] != F.floor(parsed[name]))), f"bad {name}")
        if tool == "checkpoint":
            action = F.coalesce(parsed["action"], F.lit("create"))
            reason = reason.when(own & ~action.isin(*ACTIONS), "unknown action")
            reason = reason.when(own & (action == "create") & (F.coalesce(parsed["message"], F.lit("")) == ""), "missing message")
    return requests.withColumn("reason", reason)


def route(requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """By tool: (request_id, its fields, defaults filled in), counts as integers; and dead letters with their reason."""
    return by_tool(reasons(requests))


def by_tool(judged: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The same from what reasons() gives, for callers that keep it."""
    served = {}
    for tool, fields in TOOLS.items():
        rows = judged.where((F.col("tool") == tool) & F.col("reason").isNull()).withColumn("_a", F.from_json("arguments", _schema(tool)))
        columns = []
        for name, (kind, _, default) in fields.items():
            value = F.col(f"_a.{name}") if default is None else F.coalesce(F.col(f"_a.{name}"), F.lit(default))
            columns.append((value.cast("int") if name in COUNTS else value.cast(kind)).alias(name))
        served[tool] = rows.select("request_id", *columns)
    return served, judged.where(F.col("reason").isNotNull()).select("request_id", "tool", "arguments", "reason")
