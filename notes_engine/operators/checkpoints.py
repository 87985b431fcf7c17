"""Checkpoints: versions of a keyed table. Change sets, line differences, a manifest of versions, listing, guarded restore, and a store that many writers share."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notes_engine import schemas
from notes_engine.functions import without_prefix
from notes_engine.operators.commits import Commits
from notes_engine.streaming.runs import shared_dir

MARKER = "[SAFE] "
LISTED = 20
PREVIEW = 10
KEYS = ["project_id", "key"]


def change_set(old: DataFrame, new: DataFrame, *, tracked_only: bool = False) -> DataFrame:
    """(project_id, key, status): A added, D deleted, M changed value or tags. tracked_only: without what is new. Values are compared by their SHA-256, so texts aren't sent."""
    side = lambda df: df.select(*KEYS, F.struct(F.unhex(F.sha2("value", 256)).alias("value"), "tags").alias("note"))
    both = side(old).withColumnRenamed("note", "was").join(side(new).withColumnRenamed("note", "now"), KEYS, "full_outer")
    status = F.when(F.col("was").isNull(), "A").when(F.col("now").isNull(), "D").when(~F.col("was").eqNullSafe(F.col("now")), "M")
    changed = both.select(*KEYS, status.alias("status")).where("status IS NOT NULL")
    return changed.where("status <> 'A'") if tracked_only else changed


def diff_stat(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, key, insertions, deletions) of keys whose lines differ, as multisets of lines: a moved line is no change. Lines are counted by their MD5, so texts aren't sent."""
    digests = F.transform(F.split(F.coalesce("value", F.lit("")), "\n", -1), lambda line: F.unhex(F.md5(line)))
    lines = lambda df, sign: df.select(*KEYS, F.explode(digests).alias("line"), F.lit(sign).alias("n"))
    differ = lines(old, -1).unionByName(lines(new, 1)).groupBy(*KEYS, "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return differ.groupBy(*KEYS).agg(F.sum(F.greatest("n", F.lit(0))).alias("insertions"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("deletions"))


def list_checkpoints(manifest: DataFrame, heads: DataFrame, *, marker: str = MARKER, listed: int = LISTED) -> DataFrame:
    """(project_id, place, checkpoint_id, message): each project's last marked checkpoints, newest first, from its head along the parents.

    manifest: (project_id, checkpoint_id, parent_id, message); heads: (project_id, checkpoint_id). A walk
    ends at the root or once enough marked ones are passed; unmarked ones are passed, not listed.

    Round k knows what is less than 2^k steps from a head, and from jumps of 2^k
    steps what is less than twice as far. So walks of any length take few
    rounds. Each round's tables are written to the shared folder, before this
    returns. ValueError: a walk is caught in a cycle without marked ones.
    """
    spark = manifest.sparkSession
    folder = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    marked = F.coalesce(F.startswith("message", F.lit(marker)), F.lit(False)).cast("long")
    known = stored(manifest.select("project_id", "checkpoint_id", "parent_id", "message", marked.alias("marked")), "known")
    most = known.groupBy("project_id").count().agg(F.max("count")).first()[0] or 0
    # a jump leads to id "to" and passes so many marked ones, with its start and without its end
    jumps = known.where("parent_id IS NOT NULL").select("project_id", "checkpoint_id", F.col("parent_id").alias("to"), "marked").where(F.col("marked") < listed)
    reached = [stored(heads.select("project_id", "checkpoint_id", F.lit(0).cast("long").alias("passed")), "reached-0")]
    for k in count(1):
        so_far = reduce(DataFrame.unionByName, reached)
        ahead = so_far.join(jumps, ["project_id", "checkpoint_id"]).select("project_id", F.col("to").alias("checkpoint_id"), (F.col("passed") + F.col("marked")).alias("passed"))
        ahead = stored(ahead.where(F.col("passed") < listed), f"reached-{k}")
        if ahead.isEmpty():
            break
        if 1 << (k - 1) > most * (listed + 1):
            raise ValueError("the parents of checkpoints form a cycle")
        reached.append(ahead)
        onward = jumps.select("project_id", F.col("checkpoint_id").alias("to"), F.col("to").alias("_to"), F.col("marked").alias("_marked"))
        twice = jumps.join(onward, ["project_id", "to"]).select("project_id", "checkpoint_id", F.col("_to").alias("to"), (F.col("marked") + F.col("_marked")).alias("marked"))
        jumps = stored(twice.where(F.col("marked") < listed), f"jumps-{k}")
    found = reduce(DataFrame.unionByName, reached).join(known.where("marked = 1"), ["project_id", "checkpoint_id"])
    return found.select("project_id", (F.col("passed") + 1).alias("place"), "checkpoint_id", without_prefix(F.col("message"), marker).alias("message"))


def resolve_targets(manifest: DataFrame, heads: DataFrame, wanted: DataFrame, *, marker: str = MARKER) -> DataFrame:
    """(project_id, checkpoint_id, error) for (project_id, checkpoint_id): the id given, if the manifest has it; without one, the newest listed."""
    newest = list_checkpoints(manifest, heads, marker=marker, listed=1).where("place = 1").select("project_id", F.col("checkpoint_id").alias("_newest"))
    asked = wanted.join(newest, "project_id", "left").select("project_id", F.coalesce("checkpoint_id", "_newest").alias("checkpoint_id"))
    known = manifest.select("project_id", "checkpoint_id", F.lit(True).alias("_known"))
    error = F.when(F.col("checkpoint_id").isNull(), "no checkpoints").when(F.col("_known").isNull(), "not found")
    return asked.join(known, ["project_id", "checkpoint_id"], "left").select("project_id", "checkpoint_id", error.alias("error"))


def restored(current: DataFrame, snapshots: DataFrame, targets: DataFrame, last: DataFrame) -> DataFrame:
    """The state after restoring projects to targets (project_id, checkpoint_id): their notes from the snapshot; others', and those of projects whose current notes differ from last, stay.

    current and last: notes now and at the last checkpoint; snapshots: notes with checkpoint_id.
    """
    dirty = change_set(last, current).select("project_id").distinct()
    clean = targets.join(dirty, "project_id", "left_anti")
    columns = current.columns
    kept = current.join(clean.select("project_id"), "project_id", "left_anti").select(columns)
    return kept.unionByName(snapshots.join(clean, ["project_id", "checkpoint_id"], "left_semi").select(columns))


def restore_report(current: DataFrame, last: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project_id, checkpoint_id, error) with dirty: whether the project's current notes differ from its last checkpoint; where they do and the target is known, that is the error."""
    dirty = change_set(last, current).select("project_id", F.lit(True).alias("_dirty")).distinct()
    known = targets.join(dirty, "project_id", "left").withColumn("dirty", F.coalesce("_dirty", F.lit(False)))
    error = F.coalesce("error", F.when(F.col("dirty"), "there are changes that no checkpoint holds"))
    return known.select("project_id", "checkpoint_id", "dirty", error.alias("error"))


def restore_preview(current: DataFrame, snapshots: DataFrame, last: DataFrame, targets: DataFrame) -> DataFrame:
    """What a restore would undo, nothing written: (project_id, checkpoint_id, dirty, error, key, insertions, deletions).

    A row for each key whose lines differ between the target and now, counted
    from the target; one row with a null key for a project that has none, or
    whose target isn't known. error: as in targets; a dirty project's preview is
    shown.
    """
    own = targets.where("error IS NULL")
    was = snapshots.join(own.select("project_id", "checkpoint_id"), ["project_id", "checkpoint_id"], "left_semi")
    now = current.join(own.select("project_id"), "project_id", "left_semi")
    asked = restore_report(current, last, targets).drop("error").join(targets.select("project_id", "error"), "project_id")
    return asked.join(diff_stat(was, now), "project_id", "left").select("project_id", "checkpoint_id", "dirty", "error", "key", "insertions", "deletions")


class CheckpointStore:
    """Checkpoints of a notes table under a folder that all executors reach.

    Every create and restore writes its tables under a token, in one folder of
    each kind: snapshots (the notes of its checkpoints), manifest (a row a
    checkpoint) and moves (its projects' new heads). They become part of the
    store with a commit's number, so a checkpoint never lacks its head. Writers
    don't wait for each other: one that finds the next number taken tries the
    one after it, if the commits in between moved other projects' heads alone;
    else it works again on the newer version. Readers see the version that is
    the latest when they ask, or with at() a given one.
    """

    #: How often create() and restore work again after another writer's commit.
    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.pinned = spark, path.rstrip("/"), version
        self.commits = Commits(spark, f"{self.path}/commits")

    def version(self) -> int:
        return self.commits.latest() if self.pinned is None else self.pinned

    def at(self, version: int | None = None) -> CheckpointStore:
        """The store as it is at a version, by default the latest now."""
        return CheckpointStore(self.spark, self.path, self.version() if version is None else version)

    def _read(self, name: str, schema: str, since: int = 0) -> DataFrame:
        """The rows of committed tokens, with token and number."""
        full, version = f"{schema}, token STRING", self.version()
        try:
            rows = self.spark.read.schema(full).parquet(f"{self.path}/{name}")
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], full)
        return rows.join(self.commits.table(version, since), "token")

    def _write(self, rows: DataFrame, name: str, token: str) -> DataFrame:
        folder = f"{self.path}/{name}/token={token}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def manifest(self) -> DataFrame:
        return self._read("manifest", schemas.CHECKPOINTS).drop("token", "number")

    def heads(self) -> DataFrame:
        """(project_id, checkpoint_id): the head set last of each project."""
        moves = self._read("moves", "project_id STRING, checkpoint_id STRING")
        return moves.groupBy("project_id").agg(F.max_by("checkpoint_id", "number").alias("checkpoint_id"))

    def snapshots(self, of: DataFrame | None = None) -> DataFrame:
        """Notes with checkpoint_id; of checkpoints (project_id, checkpoint_id) only, in whose tokens' folders alone Spark looks where these are few."""
        rows = self._read("snapshots", f"{schemas.NOTES}, checkpoint_id STRING").drop("number")
        if of is not None:
            made = self._read("manifest", schemas.CHECKPOINTS).select("token", "project_id", "checkpoint_id").join(of.select("project_id", "checkpoint_id"), ["project_id", "checkpoint_id"], "left_semi")
            rows = rows.join(made, ["token", "project_id", "checkpoint_id"], "left_semi")
        return rows.drop("token")

    def head_notes(self) -> DataFrame:
        return self.snapshots(self.heads()).drop("checkpoint_id")

    def _publish(self, token: str, moves: DataFrame) -> bool:
        """Commits token's tables, worked out on this version; False if a commit since moved the head of one of its projects."""
        number = self.version() + 1
        while not self.commits.publish(number, token):
            now = self.commits.latest()
            others = CheckpointStore(self.spark, self.path, now)._read("moves", "project_id STRING, checkpoint_id STRING", since=self.version())
            if not moves.join(others, "project_id", "left_semi").isEmpty():
                return False
            number = now + 1
        return True

    def create(self, notes: DataFrame, message: str | None, *, tracked_only: bool = False, dry_run: bool = False, marker: str = MARKER) -> DataFrame:
        """Stores the notes of each project that has changes since its head: (project_id, checkpoint_id, message, n_changes, preview, error).

        One message makes one checkpoint a project; only the heads of projects
        that got one move. Others have the error "no changes" and no id. preview:
        the first PREVIEW changes by key. dry_run writes nothing. With
        tracked_only, new keys are neither counted nor stored.
        """
        if not message:
            raise ValueError("a checkpoint needs a message")
        for _ in range(self.ATTEMPTS):
            seen, token = self.at(), uuid.uuid4().hex
            last = seen.head_notes()
            changes = change_set(last, notes, tracked_only=tracked_only)
            first = changes.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy("key"))).where(F.col("_n") <= PREVIEW)
            first = first.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("key", "status"))).alias("preview"))
            counted = changes.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_changes")).join(first, "project_id")
            named = counted.withColumn("checkpoint_id", F.left(F.sha2(F.concat_ws("|", F.lit(token), "project_id"), 256), F.lit(8))).withColumn("message", F.lit(f"{marker}{message}"))
            projects = notes.select("project_id").union(last.select("project_id")).distinct()
            report = projects.join(named, "project_id", "left").withColumn("error", F.when(F.col("n_changes").isNull(), "no changes"))
            if dry_run:
                return report
            heads = seen.heads().withColumnRenamed("checkpoint_id", "parent_id")
            seq = seen.manifest().groupBy("project_id").agg(F.max("seq").alias("_seq"))
            rows = report.join(heads, "project_id", "left").join(seq, "project_id", "left").withColumn("seq", F.coalesce("_seq", F.lit(0)) + 1).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz"))
            told = self._write(rows.drop("_seq"), "reports", token)  # written once: what follows has the same ids
            new = told.where("error IS NULL")
            stored = notes.join(last.select(*KEYS), KEYS, "left_semi") if tracked_only else notes
            self._write(stored.join(new.select("project_id", "checkpoint_id"), "project_id"), "snapshots", token)
            self._write(new.select(*[c.split()[0] for c in schemas.CHECKPOINTS.split(", ")]), "manifest", token)
            if seen._publish(token, self._write(new.select("project_id", "checkpoint_id"), "moves", token)):
                return told.select("project_id", "checkpoint_id", "message", "n_changes", "preview", "error")
        raise RuntimeError(f"other writers committed {self.ATTEMPTS} times meanwhile")

    def list(self, *, marker: str = MARKER) -> DataFrame:
        seen = self.at()
        return list_checkpoints(seen.manifest(), seen.heads(), marker=marker)

    def preview(self, current: DataFrame, wanted: DataFrame) -> DataFrame:
        """restore_preview() of the targets wanted (project_id, checkpoint_id; without one, the newest listed)."""
        seen = self.at()
        # Written once, beside the store's versions: of a table Spark knows the size, so that notes aren't sent to meet a small one.
        targets = self._write(resolve_targets(seen.manifest(), seen.heads(), wanted), "reports", uuid.uuid4().hex)
        return restore_preview(current, seen.snapshots(targets), seen.head_notes(), targets)

    def restore_all(self, current: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the current notes after restoring the projects of wanted to their targets, the report): projects whose target isn't known, or that are dirty, stay as they are and have an error.

        wanted: (project_id, checkpoint_id), one row a project; without an id, the newest listed. Heads of restored projects move to their targets.
        """
        for _ in range(self.ATTEMPTS):
            seen, token = self.at(), uuid.uuid4().hex
            last = seen.head_notes()
            report = self._write(restore_report(current, last, resolve_targets(seen.manifest(), seen.heads(), wanted)), "reports", token)
            chosen = report.where("error IS NULL").select("project_id", "checkpoint_id")
            kept = current.join(chosen, "project_id", "left_anti").select(current.columns)
            out = self._write(kept.unionByName(seen.snapshots(chosen).select(current.columns)), "current", token)
            if seen._publish(token, self._write(chosen, "moves", token)):
                return out, report
        raise RuntimeError(f"other writers committed {self.ATTEMPTS} times meanwhile")

    def restore(self, current: DataFrame, project_id: str, checkpoint_id: str | None = None, *, dry_run: bool = False) -> DataFrame:
        """The current notes after restoring one project; with dry_run, diff_stat() from the target to now. The head moves to the target.

        Raises LookupError without such a checkpoint, and RuntimeError where the project has changes that no checkpoint holds.
        """
        seen = self.at()
        wanted = self.spark.createDataFrame([(project_id, checkpoint_id)], "project_id STRING, checkpoint_id STRING")
        target = resolve_targets(seen.manifest(), seen.heads(), wanted).first()
        if target.error:
            raise LookupError(target.error)
        chosen = self.spark.createDataFrame([(project_id, target.checkpoint_id)], "project_id STRING, checkpoint_id STRING")
        own = current.where(F.col("project_id") == project_id)
        if dry_run:
            return diff_stat(seen.snapshots(chosen).select(current.columns), own)
        out, report = self.restore_all(current, chosen)
        if error := report.first().error:
            raise RuntimeError(error)
        return out
