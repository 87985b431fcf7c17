"""Files: note stores (a JSON array each), context documents (text), settings (JSON objects), and versioned notes tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notes_engine import schemas
from notes_engine.functions import canonical_tags

#: Bytes of a note store, besides its last note.
STORE_BYTES = 1 << 22
#: A folder of this name and a number holds a store whose first note has that position in its project.
FROM = "from="
#: A folder of this name and a kind holds a document of that kind, whatever the file's name.
KIND = "kind="
_NOTE = "struct<key:string,value:string,tags:array<string>,created_at:string,updated_at:string>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, name, body, first) of each file: its folder's name, or the one above a hidden folder, is the project; below either, from=N gives first, and kind=NAME the name. Spark passes over files of no bytes."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    number = F.regexp_extract(F.element_at(parts, -2), f"^{FROM}([0-9]+)$", 1).try_cast("long")
    kind = F.regexp_extract(F.element_at(parts, -2), f"^{KIND}(.+)$", 1)
    folder = lambda up: F.when(number.isNull() & (kind == ""), F.element_at(parts, -up)).otherwise(F.element_at(parts, -up - 1))
    project = F.when(folder(2).startswith("."), folder(3)).otherwise(folder(2))
    name = F.when(kind == "", F.element_at(parts, -1)).otherwise(kind)
    return spark.read.text(path, wholetext=True).select(project.alias("project_id"), name.alias("name"), F.col("value").alias("body"), F.coalesce(number, F.lit(0)).alias("first"))


def scan_notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, rejects) of note stores: rejects are (project_id, name, body) whose body is no JSON array; such a project must not be overwritten.

    A store is read and parsed whole; write_stores() makes as many of a project as that takes.
    """
    files = _whole(spark, path).withColumn("_notes", F.from_json("body", f"array<{_NOTE}>"))
    is_array = F.trim(F.col("body")).startswith("[") & F.col("_notes").isNotNull()
    rows = files.where(is_array).select("project_id", "first", F.posexplode("_notes").alias("position", "n"))
    time = lambda c: F.col(f"n.{c}").cast("timestamp_ntz").alias(c)
    notes = rows.select(
        "project_id", F.coalesce("n.key", F.lit("")).alias("key"), F.coalesce("n.value", F.lit("")).alias("value"), canonical_tags(F.col("n.tags")).alias("tags"),
        time("created_at"), time("updated_at"), (F.col("first") + F.col("position")).alias("position"),
    )
    return notes, files.where(~F.coalesce(is_array, F.lit(False))).select("project_id", "name", "body")


def write_stores(notes: DataFrame, path: str, *, most: int = STORE_BYTES) -> None:
    """Writes notes as stores that scan_notes() reads from path/*/*/*.txt: project_id=.../from=N/, JSON arrays of most bytes and one note at most.

    Notes are sorted by project and position over all tasks, and a task cuts
    them where a store is full; so a project is as many tasks and files as its
    size takes. from=N counts the notes of the stores before. Positions that
    have gaps become those in the project's order.
    """
    spark = notes.sparkSession
    note = F.to_json(F.struct("key", "value", "tags", F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at")))
    ranged = notes.select("project_id", "position", note.alias("note")).repartitionByRange("project_id", "position").sortWithinPartitions("project_id", "position", "note")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = number = 0
        project = None

        def full() -> pa.RecordBatch:
            columns = [pa.array([project], pa.string()), pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([f"[{','.join(held)}]"], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["project_id", "part", "number", "n", "value"])

        for batch in batches:
            for p, part, text in zip(*batch.columns, strict=True):  # noqa: B007
                p, part, text = p.as_py(), part.as_py(), text.as_py()
                if held and (p != project or size >= most):
                    yield full()
                    held, size, number = [], 0, number + 1
                project = p
                held.append(text)
                size += len(text.encode()) + 1
        if held:
            yield full()

    folder = f"{path}-cut"
    ranged.select("project_id", F.spark_partition_id().alias("part"), "note").mapInArrow(cut, "project_id string, part int, number long, n long, value string").write.parquet(folder)
    stores = spark.read.parquet(folder)
    before = F.sum("n").over(Window.partitionBy("project_id").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))  # a row a store
    first = stores.select("part", "number", F.coalesce(before, F.lit(0)).alias("from"))
    stores.join(first, ["part", "number"]).select("project_id", "from", "value").write.partitionBy("project_id", "from").text(path)


_LINE = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "columnNameOfCorruptRecord": "_bad"}


def write_note_lines(notes: DataFrame, path: str) -> None:
    """Writes notes as JSON lines, a note a line with its project and position: no store is a file of its own, and no note is moved."""
    notes.select(*[c.split()[0] for c in schemas.NOTES.split(", ")]).write.options(**_LINE, compression="gzip").json(path)


def scan_note_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, rejects) of JSON lines: rejects are (project_id, body) of lines that can't be read, of the project that they begin with, if they do.

    Null keys and values are empty, tags canonical, as in scan_notes(). Lines
    without a project or a position are rejects too. Lines are read one by one,
    so neither a project's notes nor a file need fit anywhere.
    """
    lines = spark.read.schema(f"{schemas.NOTES}, _bad STRING").options(**_LINE).json(path)
    good = F.col("_bad").isNull() & F.col("project_id").isNotNull() & F.col("position").isNotNull()
    clean = [F.coalesce("key", F.lit("")).alias("key"), F.coalesce("value", F.lit("")).alias("value"), canonical_tags(F.col("tags")).alias("tags")]
    notes = lines.where(good).select("project_id", *clean, "created_at", "updated_at", "position")
    begins = F.regexp_extract("_bad", r'^\s*\{\s*"project_id"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    rejects = lines.where(~good).select(F.coalesce("project_id", F.when(begins != "", begins)).alias("project_id"), F.coalesce("_bad", F.to_json(F.struct("project_id", "key", "value", "position"))).alias("body"))
    return notes, rejects


def scan_docs(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """(project_id, kind, body) of context documents; kinds by file name, other files are left out."""
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return _whole(spark, path).where(F.col("name").isin(*kinds)).select("project_id", kind[F.col("name")].alias("kind"), "body")


def scan_settings(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, project_name, version): missing or unreadable fields have their defaults."""
    files = _whole(spark, path).withColumn("_s", F.from_json("body", "struct<project_name:string,version:string>"))
    return files.select("project_id", F.coalesce("_s.project_name", "project_id").alias("project_name"), F.coalesce("_s.version", F.lit("4.0")).alias("version"))


def write_notes(notes: DataFrame, path: str, version: int) -> str:
    """Writes a new version of a notes table and returns its folder. The version that is being read is never overwritten.

    Files hold ranges of projects, so that a scan of one project reads the
    files whose statistics allow it, and their number follows the size.
    """
    folder = f"{path.rstrip('/')}/version={version}"
    notes.repartitionByRange("project_id", "position").sortWithinPartitions("project_id", "position").write.mode("error").parquet(folder)
    return folder


def write_guarded(notes: DataFrame, rejects: DataFrame, path: str, version: int, *, stored: DataFrame | None = None) -> DataFrame:
    """Writes a new version of a notes table without touching projects that have rejects: (project_id, n_notes, written, error), one row a project.

    notes: what is to be written. rejects: (project_id, ...) of stores that
    couldn't be read, as scan_notes() gives them; what their projects hold isn't
    known, so nothing of notes is written for them. stored: the notes as they
    are; those of refused projects are carried over as they stand. The refusal
    is part of the plan, an anti-join, so a corrupt store fails its project and
    not the table. n_notes: how many notes a project has in the new version.

    Repeated rejects of a project: refused once. Rejects without a project
    match none. Empty tables: an empty version.
    """
    refused = rejects.select("project_id").where("project_id IS NOT NULL").distinct()
    kept = notes.join(refused, "project_id", "left_anti")
    if stored is not None:
        kept = kept.unionByName(stored.join(refused, "project_id", "left_semi").select(notes.columns))
    folder = write_notes(kept, path, version)
    new = notes.sparkSession.read.schema(kept.schema).parquet(folder).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_notes"))
    projects = notes.select("project_id").union(refused).distinct()
    report = projects.join(new, "project_id", "left").join(refused.withColumn("_refused", F.lit(True)), "project_id", "left")
    written = F.col("_refused").isNull()
    return report.select("project_id", F.coalesce("n_notes", F.lit(0)).alias("n_notes"), written.alias("written"), F.when(~written, "a store of the project could not be read").alias("error"))
