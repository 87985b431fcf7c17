"""Many requests at once against the small batch's form, and the plan."""

import random

from pyspark.sql import functions as F

from notes_engine import schemas
from notes_engine.operators import recall, recall_many
from test_notes import NOTES, store

WORDS = ["alpha", "BETA", "gam", "ma", "é%", "_", "a", "ßx"]


def random_tables(spark, n, m, projects="pqr"):
    rng = random.Random(n)
    words = lambda k: " ".join(rng.choices(WORDS, k=k))
    notes = store(spark, [(rng.choice(projects), rng.choice([f"k{i % 40}", words(1)]), rng.choice([None, words(4), words(2)]), rng.choice([None, [], ["x"], ["y", "x"], ["z", None]]), rng.choice([None, 1, 2, i])) for i in range(n)])
    requests = [(i, rng.choice([*projects, "none", None]), rng.choice([None, None, "", f"k{rng.randrange(45)}"]), rng.choice([None, "", *WORDS, "ALPHA b"]), rng.choice([None, [], ["x"], ["y", "z"], ["w"]]), rng.choice([None, 0, 1, 3, 50])) for i in range(m)]
    return notes, spark.createDataFrame(requests, schemas.RECALL_REQUESTS)


def rows_of(df):
    return sorted((r.request_id, r["rank"], r.project_id, r.key, r.value, r.position) for r in df.collect())


def test_many_requests_find_what_single_ones_do(spark, monkeypatch):
    notes, requests = random_tables(spark, 300, 200)
    want = rows_of(recall.recall_batch(notes, requests))
    assert len(want) > 200 and rows_of(recall_many.recall_many(notes, requests)) == want
    monkeypatch.setattr(recall_many, "SLICE_NOTES", 9)  # projects of many slices
    assert rows_of(recall_many.recall_many(notes, requests)) == want


def test_no_notes_no_requests_and_repeated_ones(spark):
    notes, requests = random_tables(spark, 50, 30)
    assert recall_many.recall_many(notes.limit(0), requests).count() == 0 and recall_many.recall_many(notes, requests.limit(0)).count() == 0
    twice = requests.union(requests)
    assert rows_of(recall_many.recall_many(notes, twice)) == sorted(rows_of(recall_many.recall_many(notes, requests)) * 2)
    small = spark.createDataFrame([(1, "p", None, "%", None, None), (2, "p", None, None, None, -1)], schemas.RECALL_REQUESTS)
    assert {r.request_id for r in recall_many.recall_many(store(spark, NOTES), small).collect()} <= {1}


def test_plan_has_no_product_of_requests_and_notes(spark):
    notes, requests = random_tables(spark, 50, 30)
    plan = recall_many.recall_many(notes.where(F.col("key") != "-"), requests)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
