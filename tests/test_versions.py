"""Checkpoint stores with many writers, previews, and guarded writes."""

import pytest
from pyspark.sql import functions as F

from notes_engine.operators import checkpoints
from notes_engine.operators.commits import Commits
from notes_engine.sources import files
from test_notes import store


def test_a_number_has_one_writer(spark, tmp_path):
    commits = Commits(spark, f"file://{tmp_path}/c")
    assert commits.latest() == 0 and commits.table(0).count() == 0
    assert commits.publish(1, "a") and not commits.publish(1, "b") and commits.publish(2, "b")
    assert commits.latest() == 2 and sorted(map(tuple, commits.table(2).select("number", "token").collect())) == [(1, "a"), (2, "b")]
    assert [r.token for r in commits.table(2, since=1).collect()] == ["b"] and [r.token for r in commits.table(1).collect()] == ["a"]
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if not p.name.endswith(".crc")) == ["00000000000000000001.json", "00000000000000000002.json"]


def between(monkeypatch, kept, act):
    """Has another writer act once, just before kept's next commit."""
    publish, left = Commits.publish, [act]

    def late(self, number, token):
        if left:
            left.pop()()
        return publish(self, number, token)

    monkeypatch.setattr(Commits, "publish", late)


def test_of_two_writers_of_a_project_the_second_works_again(spark, tmp_path, monkeypatch):
    kept = checkpoints.CheckpointStore(spark, f"file://{tmp_path}/s")
    notes = lambda v: store(spark, [("p", "k", v, None, 0)])
    kept.create(notes("1"), "one")
    between(monkeypatch, kept, lambda: kept.create(notes("2"), "two"))
    report = kept.create(notes("3"), "three").first()
    assert report.n_changes == 1 and report.error is None
    assert [(r.place, r.message) for r in kept.list().orderBy("place").collect()] == [(1, "three"), (2, "two"), (3, "one")]
    assert [r.value for r in kept.head_notes().collect()] == ["3"] and kept.version() == 3
    between(monkeypatch, kept, lambda: kept.create(notes("5"), "five"))
    assert kept.create(notes("5"), "five again").first().error == "no changes"  # the other stored just that


def test_writers_of_other_projects_need_no_second_work(spark, tmp_path, monkeypatch):
    kept = checkpoints.CheckpointStore(spark, f"file://{tmp_path}/s")
    q = store(spark, [("q", "k", "other", None, 0)])
    between(monkeypatch, kept, lambda: kept.create(q, "of q"))
    worked = []
    monkeypatch.setattr(checkpoints, "change_set", lambda *a, f=checkpoints.change_set, **b: (worked.append(1), f(*a, **b))[1])
    kept.create(store(spark, [("p", "k", "own", None, 0)]), "of p")
    assert len(worked) == 2 and kept.version() == 2  # one each
    assert {(r.project_id, r.message) for r in kept.list().collect()} == {("p", "of p"), ("q", "of q")}


def test_readers_keep_their_version_and_half_written_work_is_not_seen(spark, tmp_path, monkeypatch):
    kept = checkpoints.CheckpointStore(spark, f"file://{tmp_path}/s")
    kept.create(store(spark, [("p", "k", "1", None, 0)]), "one")
    before = kept.at()
    kept.create(store(spark, [("p", "k", "2", None, 0)]), "two")
    assert [r.value for r in before.head_notes().collect()] == ["1"] and before.manifest().count() == 1 and before.list().count() == 1
    assert [r.value for r in kept.at(1).head_notes().collect()] == ["1"] and [r.value for r in kept.head_notes().collect()] == ["2"]

    def dies(self, number, token):
        raise OSError("gone")

    with monkeypatch.context() as m, pytest.raises(OSError, match="gone"):
        m.setattr(Commits, "publish", dies)
        kept.create(store(spark, [("p", "k", "3", None, 0)]), "three")
    assert [r.value for r in kept.head_notes().collect()] == ["2"] and kept.manifest().count() == 2 and kept.snapshots().count() == 2
    kept.create(store(spark, [("p", "k", "3", None, 0)]), "three")
    assert [r.message for r in kept.list().orderBy("place").collect()] == ["three", "two", "one"]


def test_restoring_many_and_previews(spark, tmp_path):
    kept = checkpoints.CheckpointStore(spark, f"file://{tmp_path}/s")
    rows = lambda **v: store(spark, [(p, "k", x, None, 0) for p, x in v.items()])
    kept.create(rows(a="1", b="1", c="1"), "one")
    one = kept.heads()
    kept.create(rows(a="1\n2", b="2", c="1"), "two")
    now = rows(a="1\n2", b="2!", c="1", d="new")
    wanted = one.where("project_id <> 'c'").union(spark.createDataFrame([("c", "zz"), ("d", None)], "project_id string, checkpoint_id string"))
    seen = {(r.project_id, r.dirty, r.error, r.key, r.insertions, r.deletions) for r in kept.preview(now, wanted).collect()}
    assert seen == {("a", False, None, "k", 1, 0), ("b", True, None, "k", 1, 1), ("c", False, "not found", None, None, None), ("d", True, "no checkpoints", None, None, None)}
    assert kept.version() == 2
    notes, report = kept.restore_all(now, wanted)
    assert {(r.project_id, r.error) for r in report.collect()} == {("a", None), ("b", "there are changes that no checkpoint holds"), ("c", "not found"), ("d", "no checkpoints")}
    assert {(r.project_id, r.value) for r in notes.collect()} == {("a", "1"), ("b", "2!"), ("c", "1"), ("d", "new")}
    assert {(r.project_id, r.place, r.message) for r in kept.list().collect()} == {("a", 1, "one"), ("b", 1, "two"), ("b", 2, "one"), ("c", 1, "one")}


def test_a_create_makes_one_folder_of_each_kind(spark, tmp_path):
    kept = checkpoints.CheckpointStore(spark, f"file://{tmp_path}/s")
    kept.create(store(spark, [(f"p{k}", "k", "1", None, 0) for k in range(40)]), "one")
    for kind in ("snapshots", "manifest", "moves"):
        assert len(list((tmp_path / "s" / kind).iterdir())) == 1
    assert kept.manifest().select("checkpoint_id").distinct().count() == 40


def test_guarded_write_fails_projects_and_not_the_table(spark, tmp_path):
    stored = store(spark, [("p", "k", "old", None, 0), ("q", "k", "old", None, 0), ("q", "l", "old", None, 0)])
    notes = stored.withColumn("value", F.lit("new")).union(store(spark, [("r", "k", "new", None, 0)]))
    rejects = spark.createDataFrame([("q", "a.json", "{cut"), ("q", "b.json", ""), ("x", "c.json", "?"), (None, "d", "?")], "project_id string, name string, body string")
    report = files.write_guarded(notes, rejects, f"{tmp_path}/t", 2, stored=stored)
    error = "a store of the project could not be read"
    assert {tuple(r) for r in report.collect()} == {("p", 1, True, None), ("q", 2, False, error), ("r", 1, True, None), ("x", 0, False, error)}
    table = spark.read.parquet(f"{tmp_path}/t/version=2")
    assert sorted((r.project_id, r.key, r.value) for r in table.collect()) == [("p", "k", "new"), ("q", "k", "old"), ("q", "l", "old"), ("r", "k", "new")]
    assert {r.project_id for r in files.write_guarded(notes, rejects, f"{tmp_path}/t", 3).where("written").collect()} == {"p", "r"}
    with pytest.raises(Exception, match="already exists"):
        files.write_guarded(notes, rejects, f"{tmp_path}/t", 3)
    assert files.write_guarded(notes.limit(0), rejects.limit(0), f"{tmp_path}/t", 4).count() == 0
