"""Raw tool events: one JSON text a call, as the caller hands it over, into tool events and dead letters. The same for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CALL = "tool_name STRING, cwd STRING, tool_input STRUCT<file_path: STRING>, _bad STRING"


def _parsed(lines: DataFrame) -> DataFrame:
    parsed = F.from_json("line", _CALL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumns({"_call": parsed, "_broken": F.col("line").isNull() | parsed.isNull() | parsed["_bad"].isNotNull() | ~F.trim("line").startswith("{")})


def parse_calls(lines: DataFrame) -> DataFrame:
    """Tool events (schemas.TOOL_EVENTS) from (session_id, ts, event_id, line).

    The project is the last part of cwd. A line that is no JSON object has no
    tool_name, which the gate takes for malformed and lets pass; an object
    without a tool has an empty one. Null lines: malformed. Empty table: no rows.
    """
    call = _parsed(lines)
    whole = lambda c: F.when(~F.col("_broken"), c)
    project = F.element_at(F.split(F.rtrim(F.col("_call.cwd"), F.lit("/")), "/"), -1)
    return call.select(
        "session_id", whole(project).alias("project_id"), whole(F.coalesce("_call.tool_name", F.lit(""))).alias("tool_name"), whole(F.col("_call.tool_input.file_path")).alias("file_path"), "ts", "event_id",
    )


def dead_calls(lines: DataFrame) -> DataFrame:
    """The rows of lines that parse_calls() can't read, as they are."""
    return _parsed(lines).where("_broken").select(lines.columns)
