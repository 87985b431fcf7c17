"""The pipeline, stage by stage, against plain versions of what each must do."""

import random
import re
import zlib

import corpus_pipeline as cp
import pytest
from test_ngram_join import slow_components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n=80):
    return " ".join(rng.choice(["ka", "lo", "mi", "te", "ru"]) + rng.choice(["n", "sta", "vel", "do"]) + str(rng.randrange(9)) for _ in range(n))


def test_stages_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        if k == 4:
            pieces = out.collect()
            assert {p.doc_id for p in pieces} == set(rows)
            assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
            break
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert got.items() <= rows.items()
        if k == 1:
            least = {}
            for i, t in sorted(rows.items()):
                least.setdefault((t or "").translate(AZ), i)
            assert set(got) == set(least.values())
        if k == 2:
            assert set(got) == {i for i, _, c in slow_components(list(rows.items())) if i == c}
        if k == 3:
            assert len(got) > 0.7 * len(rows)
        docs, rows = spark.createDataFrame(out.collect(), out.schema), got


def test_stages_on_edges(spark, sf_dir, clash, make_docs):
    rng = random.Random(4)
    a, b = prose(rng), prose(rng)
    docs = clash([(1, a), (2, a.upper()), (3, re.sub(r"(\w+)$", "end", a)), (4, b), (4, b), (5, None), (6, ""), (None, prose(rng)), (None, prose(rng)), (7, "$$$ " * 50)])
    kept = cp.quality(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 4] and kept.count() == 7
    one = cp.exact(spark, kept, sf_dir)
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [1, 3, 4] and one.count() == 5
    far = cp.near(spark, one, sf_dir)
    assert sorted(r.doc_id for r in far.collect() if r.doc_id is not None) == [1, 4] and far.count() == 4
    assert far.columns == docs.columns
    mixed = cp.mix(spark, far, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() <= 4
    empty = make_docs([])
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_mixing_comes_to_the_fitted_totals(spark, sf_dir, monkeypatch):
    """No rate is above 1, so the stage's rows are the fitted decision and its totals near those fitted and the targets."""
    fit, mixes = cp.mixing.fit_mix, []
    monkeypatch.setattr(cp.mixing, "fit_mix", lambda scored, *args, **options: mixes.append((scored, fit(scored, *args, **options))) or mixes[-1][1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id for r in cp.mix(spark, docs, sf_dir).collect()}
    ((scored, mix),) = mixes
    rows = cp.mixing.apply_mix(scored, mix).select("_row.doc_id", "n_tokens", "posterior", "rate", "copies").collect()
    assert max(r.rate for r in rows) <= 1 and {r.doc_id for r in rows if r.copies} == out
    for k in range(len(mix.natural)):
        expected = sum(r.n_tokens * r.posterior[k] * r.rate for r in rows)
        assert expected == pytest.approx(mix.reached[k], rel=0.02, abs=1)
        assert abs(sum(r.n_tokens * r.posterior[k] for r in rows if r.doc_id in out) - mix.target[k]) < 0.15 * sum(mix.natural)


def test_packing_has_the_ids(spark, sf_dir, make_docs):
    docs = make_docs(["one two three", None, "word " * 5000])
    pieces = cp.packing(spark, docs, sf_dir).collect()
    assert all(len(p.ids) == p.length and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) for p in pieces) and len(pieces) > 3


def test_near_tells_rows_of_one_id_apart(spark, sf_dir, clash):
    rng = random.Random(8)
    a, b, c, d = (prose(rng) for _ in range(4))
    docs = clash([(1, a), (2, f"{a} end"), (2, b), (3, c), (3, f"{c} end"), (None, d), (None, f"{d} end"), (None, f"{a} fin"), (4, None)])
    kept = [(r.doc_id, r.text) for r in cp.near(spark, docs, sf_dir).collect()]
    assert len(kept) == 5 and {(1, a), (2, b), (4, None)} < set(kept)
    assert {i for i, t in kept if t and t.startswith(c)} == {3} and {i for i, t in kept if t and t.startswith(d)} == {None}


def test_last_stages_pass_small_batches(spark, sf_dir, make_docs, monkeypatch):
    """Where mixing and packing read texts, batches are those of BATCH, and packing remembers less; the session and the worker's encoder are as before after that."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, write = spark.conf.get(key, None), cp.stored
    monkeypatch.setattr(cp, "stored", lambda df, name: seen.append((name, spark.conf.get(key))) or write(df, name))
    docs = make_docs([(k, f"one two {k}") for k in range(20)])
    cp.mix(spark, docs, sf_dir)
    assert cp.packing(spark, docs, sf_dir).count() >= 20
    assert seen == [("scored", cp.BATCH), ("packed", cp.BATCH)] and spark.conf.get(key, None) == before
