"""Lines of version-control output, as tables of (project_id, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notes_engine.functions import without_prefix
from notes_engine.operators.checkpoints import MARKER


def parse_status(lines: DataFrame) -> DataFrame:
    """(project_id, status, file): a code in the first two columns, a path from the fourth. Empty lines are left out."""
    return lines.where(F.length("line") > 0).select("project_id", F.trim(F.substring("line", 1, 2)).alias("status"), F.substr("line", F.lit(4)).alias("file"))


def parse_log(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """(project_id, checkpoint_id, message, marked): the id is up to the first blank; a marker in front of the message is taken off."""
    rest = F.regexp_extract("line", r"(?s)^[^ ]* (.*)$", 1)
    return lines.where(F.length("line") > 0).select("project_id", F.substring_index("line", " ", 1).alias("checkpoint_id"), without_prefix(rest, marker).alias("message"), rest.startswith(marker).alias("marked"))
