"""Domain tables from the test tables, whole."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.operators.checkpoints import MARKER


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def notes(documents: DataFrame) -> DataFrame:
    """A note per document; the project is its source. Times have ties on purpose."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    later = F.timestamp_add("SECOND", F.col("n_chars"), start)
    return documents.select(
        F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"), F.array("lang").alias("tags"),
        start.alias("created_at"), later.alias("updated_at"), F.col("doc_id").alias("position"),
    )


def note_events(events: DataFrame) -> DataFrame:
    """Each event as a mutation of one of its user's notes."""
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.when(F.col("event_type") == "error", "forget").when(F.col("event_type").isin("click", "signup"), "append").otherwise("replace")
    return events.select(
        F.col("user_id").cast("string").alias("project_id"), F.floor(k / 20).cast("string").alias("key"), op.alias("op"), F.col("event_id").cast("string").alias("value"),
        F.array("event_type").alias("tags"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"),
    )


def old_notes(documents: DataFrame) -> DataFrame:
    """A first version of the notes: without those in Spanish."""
    return notes(documents.where(F.col("lang") != "es"))


def new_notes(documents: DataFrame) -> DataFrame:
    """A second version: without those in German, French ones a line longer."""
    value = F.when(F.col("lang") == "fr", F.concat("text", F.lit("\nextra"))).otherwise(F.col("text"))
    return notes(documents.where(F.col("lang") != "de").withColumn("text", value))


def conversation_docs(conversations: DataFrame) -> DataFrame:
    """Turns as context documents: the role is the kind, system stands for settings."""
    kind = F.when(F.col("role") == "system", "settings").when(F.col("role") == "user", "map").otherwise("task")
    return conversations.select(F.col("conv_id").cast("string").alias("project_id"), kind.alias("kind"), F.col("text").alias("body"))


def conversation_sections(conversations: DataFrame) -> DataFrame:
    """Turns as sections, in order, under their role."""
    return conversations.select(F.col("conv_id").cast("string").alias("project_id"), F.col("turn").alias("place"), F.concat(F.lit("# "), "role", F.lit("\n\n"), "text").alias("section"))


def manifest(orders: DataFrame) -> DataFrame:
    """A customer's orders, in time, as a chain of checkpoints; urgent and high ones are marked."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    marked = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")
    return orders.select(
        F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderkey").cast("string").alias("checkpoint_id"), F.lag("o_orderkey").over(order).cast("string").alias("parent_id"),
        F.row_number().over(order).cast("long").alias("seq"), F.when(marked, F.concat(F.lit(MARKER), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("message"),
    )


def heads(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.groupBy("project_id").agg(F.max_by("checkpoint_id", "seq").alias("checkpoint_id"))


def tool_events(events: DataFrame) -> DataFrame:
    """signup is onboarding, click and purchase change files, of which every one with value below 5 is exempt; errors are malformed."""
    tool = F.when(F.col("event_type") == "signup", "onboard").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "purchase", "Write").when(F.col("event_type") == "view", "Read")
    path = F.when(F.col("value") < 5, F.lit(".claude/map.md")).otherwise(F.concat(F.lit("src/"), F.col("event_id").cast("string")))
    return events.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("user_id").cast("string").alias("project_id"), tool.alias("tool_name"), path.alias("file_path"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id",
    )


def requests(events: DataFrame) -> DataFrame:
    """Each event as a request; errors name an unknown tool, purchases under 10 lack their value, views ask for value rows."""
    tool = F.when(F.col("event_type") == "signup", "onboard").when(F.col("event_type").isin("click", "purchase"), "remember").when(F.col("event_type") == "view", "recall").otherwise("unknown")
    value = F.when((F.col("event_type") == "purchase") & (F.col("value") < 10), None).otherwise(F.col("event_type"))
    arguments = F.when(F.col("event_type") == "view", F.to_json(F.struct(F.col("user_id").cast("string").alias("project_id"), F.col("value").alias("limit")))).otherwise(
        F.to_json(F.struct(F.col("user_id").cast("string").alias("project_id"), F.col("event_id").cast("string").alias("key"), value.alias("value")))
    )
    return events.select(F.col("event_id").alias("request_id"), tool.alias("tool"), arguments.alias("arguments"))


def _day_time(documents: DataFrame):
    """Every document ten minutes after the one before it."""
    return F.timestamp_add("SECOND", F.col("doc_id") * 600, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def document_events(documents: DataFrame) -> DataFrame:
    """Each document as a mutation of one of its source's notes: its length chooses the note and, in one of eleven, forgets it."""
    n = F.col("n_chars")
    op = F.when(n % 11 == 3, "forget").when(n % 3 == 0, "replace").otherwise("append")
    return documents.select(
        F.col("source").alias("project_id"), (n % 10).cast("string").alias("key"), op.alias("op"), F.md5("text").alias("value"), F.array("lang").alias("tags"),
        _day_time(documents).alias("ts"), F.col("doc_id").alias("seq"),
    )


def document_tool_events(documents: DataFrame) -> DataFrame:
    """Each document as a tool event of its source's session in its language's project: its length chooses the tool; one in seven changes an exempt path."""
    n = F.col("n_chars") % 20
    tool = F.when(n == 0, "onboard").when(n <= 9, "Edit").when(n <= 14, "Write").when(n <= 18, "Read")
    path = F.when(F.col("n_chars") % 7 == 0, F.lit(".claude/map.md")).otherwise(F.concat(F.lit("src/"), F.md5("text")))
    return documents.select(F.col("source").alias("session_id"), F.col("lang").alias("project_id"), tool.alias("tool_name"), path.alias("file_path"), _day_time(documents).alias("ts"), F.col("doc_id").alias("event_id"))


def document_requests(documents: DataFrame) -> DataFrame:
    """Each document as a recall request in its source, by its length: for a key, that of a document behind it; for a piece of its text, with a tag or without; for a tag; or for all."""
    n = F.col("n_chars")
    piece = F.translate(F.substring("text", 3, 12), string.ascii_lowercase, string.ascii_uppercase)  # engines differ in the upper case of other letters
    return documents.select(
        F.col("doc_id").alias("request_id"), F.col("source").alias("project_id"), F.when(n % 4 == 0, (F.col("doc_id") + n % 3).cast("string")).alias("key"), F.when((n % 4 == 1) | (n % 4 == 2), piece).alias("query"),
        F.when(n % 4 == 2, F.array(F.lit("en"), F.lit("none"))).when(n % 8 == 3, F.array("lang")).alias("tags"), F.when(n % 5 != 4, n % 5).cast("int").alias("max_rows"),
    )


def document_request_log(documents: DataFrame) -> DataFrame:
    """Each document as a request, by its length: every tool, every checkpoint action, and every error."""
    n = F.col("n_chars")
    kind = n % 12
    project, nothing = F.col("source").alias("project_id"), F.lit(None).cast("string")
    checkpoint = F.to_json(F.struct(
        project, F.when(kind == 2, "list").when(kind == 3, "rollback").when(kind == 4, "drop").alias("action"), F.when(kind == 0, F.md5("text")).alias("message"),
        F.when(kind == 3, F.left(F.md5("text"), F.lit(8))).alias("checkpoint_id"), F.when(n % 5 == 0, True).alias("dry_run"),
    ))
    remember = F.to_json(F.struct(project, F.col("doc_id").cast("string").alias("key"), F.when(kind == 5, F.md5("text")).otherwise(nothing).alias("value")))
    recall = F.to_json(F.struct(project, F.when(kind == 11, F.col("doc_id").cast("string")).alias("key"), (n % 5 - 1).alias("limit")))
    onboard = F.to_json(F.struct(project, F.when(n % 5 == 0, n).alias("max_context_chars")))
    tool = F.when(kind <= 4, "checkpoint").when(kind <= 6, "remember").when((kind == 7) | (kind == 11), "recall").when(kind == 9, "unknown").otherwise("onboard")
    arguments = F.when(kind <= 4, checkpoint).when(kind <= 6, remember).when((kind == 7) | (kind == 11), recall).when(kind == 10, F.left(onboard, F.length(onboard) - 2)).otherwise(onboard)
    return documents.select(F.col("doc_id").alias("request_id"), tool.alias("tool"), arguments.alias("arguments"))


def document_calls(documents: DataFrame) -> DataFrame:
    """document_tool_events() as raw lines, of which those of one in nine are cut off."""
    events = document_tool_events(documents.withColumn("source", F.struct("source", (F.col("n_chars") % 9 == 0).alias("cut"))))
    line = F.to_json(F.struct("tool_name", F.concat(F.lit("/home/work/"), "project_id", F.lit("/")).alias("cwd"), F.struct("file_path").alias("tool_input")))
    return events.select(F.col("session_id.source").alias("session_id"), "ts", "event_id", F.when(F.col("session_id.cut"), F.left(line, F.length(line) - 2)).otherwise(line).alias("line"))


def source_files(documents: DataFrame) -> DataFrame:
    """(project_id, kind, value): the longest text of each source in each language as one of its documents; for one language settings instead, of which some can't be read."""
    longest = documents.groupBy("source", "lang").agg(F.max_by("text", F.struct("n_chars", "doc_id")).alias("text"), F.max("n_chars").alias("n"))
    kind = F.when(F.col("lang") == "en", "map").when(F.col("lang") == "de", "decisions").when(F.col("lang") == "fr", "task").otherwise("settings")
    settings = F.when(F.col("n") % 2 == 0, F.concat(F.lit('{"project_name": "Project '), "source", F.lit('", "version": "5.'), F.col("n").cast("string"), F.lit('"}'))).otherwise('{"project_name": "cut')
    return longest.select(F.col("source").alias("project_id"), kind.alias("kind"), F.when(kind == "settings", settings).otherwise(F.col("text")).alias("value"))
