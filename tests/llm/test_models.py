"""Toxicity and mixing: held-out accuracy, targets reached, and edges."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notes_engine.llm import mixing, toxicity
from notes_engine.llm.ngram_model import BITS, LENGTH_POWER, NgramModel, _ratio, buckets_of, softmax
from notes_engine.llm.tokens import DEFAULT_VOCABULARY

PROSE = [f"{a}{b}" for a in ("ka", "lo", "mi", "te", "ru") for b in ("n", "sta", "vel", "do")]
BAD = ["grumbol", "snarfik"]


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(PROSE) for _ in range(rng.randrange(20, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD).upper() if rng.random() < 0.3 else rng.choice(BAD)
        docs.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, make_docs):
    docs, labels = corpus()
    return make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")


def test_toxicity_held_out(tables):
    docs, labels = tables
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_labels_change_nothing(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_toxicity(docs, x) for x in (labels, flipped))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.bias, b.bias)


def test_toxicity_of_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.op8_toxicity(spark, d).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good])
    assert auc > 0.85
    assert np.mean([x >= 0.7 for x in good]) < 0.03


def test_toxicity_edges(spark, clash, make_docs):
    docs, labels = corpus(120, 3)
    model = toxicity.fit_toxicity(make_docs(docs), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (5, 1, 1), (9999, 0, 1)], "doc_id long, quality long, toxic long"))
    rows = toxicity.score_toxicity(clash([(1, None), (1, ""), (None, "grumbol"), (4, "x" * 200_000)]), model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(clash([]), model).count() == 0
    empty = toxicity.fit_toxicity(make_docs([]), spark.createDataFrame([], "doc_id long, quality long, toxic long"))
    assert [r.score for r in toxicity.score_toxicity(clash(["a"]), empty).collect()] == [0.5]


def test_buckets():
    assert len(buckets_of("")) == 0 or buckets_of("").max() < 1 << 21
    assert np.array_equal(buckets_of("AbC\nd"), buckets_of("aBc d"))
    assert not np.array_equal(buckets_of("abcd"), buckets_of("abdc"))


def plain_buckets(text, orders):
    """Every n-gram's bucket, one by one, in whole numbers."""
    code = [ord(c) for c in f" {text.lower()} ".replace("\n", " ")]
    for n in orders:
        for k in range(len(code) - n + 1):
            h = 0
            for c in code[k : k + n]:
                h = (h * 0x01000193 + c) % 2**32
            h = (h + n) % 2**32
            h = (h ^ (h >> 15)) * 0x85EBCA6B % 2**32
            yield (h ^ (h >> 13)) >> 11


def plain_odds(text, model):
    found = list(plain_buckets(text, model.orders))
    return [float(b) + sum(float(w[k]) for k in found) / max(1, len(found)) ** 0.25 for w, b in zip(model.weights, model.bias, strict=True)]


def test_op8_against_plain_scores(spark):
    """The registered query: every document's score from its n-grams one by one."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    scored = {r.doc_id: r for r in toxicity.op8_toxicity(spark, d).collect()}
    rows = docs.collect()
    assert len(scored) == len(rows)
    for r in rows[:60]:
        want = 1 / (1 + math.exp(-plain_odds(r.text or "", model)[0]))
        assert scored[r.doc_id].score == pytest.approx(want, abs=1e-4)
        assert scored[r.doc_id].predicted == int(scored[r.doc_id].score >= 0.7)
        assert scored[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_ratio_is_the_bound_nearer_to_nought():
    own, first = np.array([0, 1, 90, 5]), np.array([0, 0, 10, 95])
    got = _ratio(own, 100.0, first, 300.0)
    for k in (2, 3):
        p, q = own[k] + 0.5, first[k] + 1.5
        full, error = math.log(p / 0.25) - math.log(q / 0.75), math.sqrt(1 / p + 1 / q)
        assert got[k] == pytest.approx(math.copysign(max(0, abs(full) - 3 * error), full), abs=1e-4)
    assert got[0] == got[1] == 0 and got[2] > 0 > got[3]
    assert not _ratio(own, 0.0, first, 300.0).any()


# mixing


def mixed(docs, labels, weights, **more):
    model = mixing.fit_domains(docs, mixing.label_domains(labels), tuple(weights))
    scored = mixing.with_posteriors(docs, model).cache()
    mix = mixing.fit_mix(scored, weights, **more)
    return mix, mixing.apply_mix(scored, mix)


def test_mix_reaches_its_targets(tables):
    docs, labels = tables
    mix, out = mixed(docs, labels, {"clean": 0.95, "toxic": 0.05})
    assert mix.gap < 0.01 and np.allclose(mix.reached, mix.target, atol=0.01 * sum(mix.natural))
    rows = out.join(labels, "doc_id").collect()
    clean, bad = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert sum(r.copies >= 1 for r in clean) > 0.98 * len(clean)
    tokens = lambda some: sum(r.n_tokens * r.copies for r in some)
    assert tokens(bad) / tokens(rows) == pytest.approx(0.05, abs=0.03)
    assert all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in rows)


def test_rates_are_the_least_squares_minimum(tables):
    """The fitted rates minimise the penalised loss: small moves of any kind don't lower it."""
    docs, labels = tables
    mix, out = mixed(docs, labels, {"clean": 0.95, "toxic": 0.05})
    rows = out.collect()
    p, r, n = np.array([x.posterior for x in rows]), np.array([x.rate for x in rows]), np.array([x.n_tokens for x in rows], float)
    natural, target = np.array(mix.natural), np.array(mix.target)
    loss = lambda r: 0.5 * ((((n * r) @ p - target) ** 2) / natural).sum() + 0.5 * mixing.RIDGE * (n * (r - 1) ** 2).sum()
    rng, best = np.random.default_rng(0), loss(r)
    for _ in range(200):
        moved = np.maximum(0, r + rng.normal(0, 0.05, len(r)) * (rng.random(len(r)) < 0.3))
        assert loss(moved) >= best * 0.995


@pytest.mark.parametrize("highest", [None, 1.0])
def test_rates_against_a_plain_loop(tables, highest):
    docs, labels = tables
    weights = {"clean": 0.95, "toxic": 0.05}
    mix, out = mixed(docs, labels, weights, highest=highest)
    plain_rates(out.collect(), list(weights.values()), highest)


def plain_rates(rows, weights, highest=None):
    """The projected gradient over all rows at once, and the copies that follow."""
    p, n = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows], float)
    natural, share = n @ p, np.array(weights)
    target = np.minimum(share * natural[0] / share[0], natural)
    rate, before, now, steps = np.ones(len(n)), np.full(len(share), np.inf), natural, 0
    while steps < mixing.STEPS and np.abs(now - target).max() > 0 and np.abs(now - before).max() > mixing.TOLERANCE * natural.sum():
        rate = np.maximum(0, rate - (p @ ((now - target) / natural) + mixing.RIDGE * (rate - 1)) / (1 + mixing.RIDGE))
        rate = rate if highest is None else np.minimum(highest, rate)
        before, now, steps = now, (n * rate) @ p, steps + 1
    assert np.allclose(rate, [r.rate for r in rows], atol=1e-6)
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rows)
    return now, target, natural


def test_op4_against_a_plain_loop(spark):
    """The registered query: tokens as the library counts them, posteriors from n-grams one by one, rates and domains from those."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.op4_mixing(spark, d).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    tokenizer = Tokenizer.from_file(DEFAULT_VOCABULARY)
    model = mixing.fit_domains(docs, mixing.label_domains(labels), tuple(mixing.DOMAIN_WEIGHTS))
    for k, r in enumerate(rows):
        assert r.n_tokens == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.domain == list(mixing.DOMAIN_WEIGHTS)[int(np.argmax(r.posterior))]
        if k < 40:
            e = np.exp([0, *plain_odds(texts[r.doc_id], model)])
            assert np.allclose(r.posterior, e / e.sum(), atol=1e-4)
    now, target, natural = plain_rates(rows, list(mixing.DOMAIN_WEIGHTS.values()))
    assert rows[0].gap == pytest.approx(np.abs(now - target).max() / natural.sum(), abs=1e-6)


def test_upsampling_repeats(make_docs, spark):
    docs, labels = corpus(200, 5)
    mix, out = mixed(make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality long, toxic long"), {"clean": 0.95, "toxic": 0.05})
    doubled = mixing.Mix(mix.domains, ((-1.0, -1.0),), mix.natural, mix.target, mix.reached)
    assert {r.copies for r in mixing.apply_mix(out, doubled).collect()} <= {1, 2, 3}


def test_mixing_edges(spark, clash, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, None), (None, 1, 1), (4, None, None)], "doc_id long, quality long, toxic long")
    assert {(r.doc_id, r.domain) for r in mixing.label_domains(labels).collect()} == {(1, "clean"), (2, "toxic"), (3, "low_quality")}
    docs = clash([(1, "a b c"), (2, None), (3, ""), (None, "d"), (3, ""), (6, "x" * 300_000), (7, "a b c"), (7, "a b c")])
    _, out = mixed(docs, labels, mixing.DOMAIN_WEIGHTS)
    rows = out.collect()
    assert len(rows) == 8 and all(r.rate >= 0 for r in rows)
    seven = [(tuple(r.posterior), r.rate, r.copies) for r in rows if r.doc_id == 7]
    assert len(seven) == 2 and len(set(seven)) == 1
    # no labels: all domains are equally likely, and each document counts to each in a third
    level, out = mixed(make_docs([(1, "one two"), (2, "three")]), labels.limit(0), mixing.DOMAIN_WEIGHTS)
    assert all(np.allclose(r.posterior, 1 / 3) for r in out.collect()) and len(set(level.natural)) == 1
    none, out = mixed(make_docs([]), labels.limit(0), mixing.DOMAIN_WEIGHTS)
    assert out.count() == 0 and none.gap == 0


def test_an_ngram_is_looked_up_once_for_all_classes():
    rng = np.random.default_rng(1)
    model = NgramModel(rng.normal(size=(2, 1 << BITS)).astype(np.float32), np.array([0.5, -0.25]), (4, 6))
    texts = ["", "ab", "some words of a text " * 900]
    found = [buckets_of(t, model.orders) for t in texts]
    odds = np.array([model.bias + np.array([w[b].sum(dtype=np.float64) for w in model.weights]) / max(1, len(b)) ** LENGTH_POWER for b in found])
    assert np.array_equal(model.probabilities(texts), softmax(odds)) and model._by_bucket.flags.c_contiguous


def test_a_model_is_sent_without_its_empty_buckets():
    """A fitted model has weights for few buckets; only these are pickled, and its probabilities are the same to the bit."""
    import pickle

    weights = np.zeros((2, 1 << BITS), np.float32)
    rng = np.random.default_rng(3)
    weights[:, rng.integers(0, 1 << BITS, 20_000)] = rng.normal(size=(2, 20_000))
    model, texts = NgramModel(weights, np.array([0.5, -0.25]), (4, 6)), [t for _, t in corpus(50)[0]]
    raw = pickle.dumps(model)
    sent = pickle.loads(raw)
    assert len(raw) < 500_000 and (sent.weights == weights).all() and sent._by_bucket.base is sent.weights.base  # one table
    assert (sent.probabilities(texts) == model.probabilities(texts)).all()
    none = pickle.loads(pickle.dumps(NgramModel(np.zeros((0, 1 << BITS), np.float32), np.zeros(0))))
    assert none.probabilities(["a b"]).tolist() == [[1.0]]


def test_products_pass_over_entries_with_weight_alone():
    """Sparse products are those of the dense matrix, texts and buckets without entries included; entries of no weight are not kept."""
    from notes_engine.llm.ngram_model import _Features

    rng = np.random.default_rng(5)
    dense = np.where(rng.random((9, 30)) < 0.3, rng.normal(size=(9, 30)), 0).astype(np.float32)
    dense[[0, 4, 8]] = 0
    rows, cols = np.divmod(np.arange(dense.size), 30)
    x = _Features(rows, cols, dense.ravel(), dense.shape)
    w, d = rng.normal(size=30), rng.normal(size=9)
    assert len(x.values) == len(x.held) == (dense != 0).sum()
    assert np.allclose(x.by_text(w), dense.astype(float) @ w, rtol=0, atol=1e-12) and np.allclose(x.by_bucket(d), dense.astype(float).T @ d, rtol=0, atol=1e-12)
    none = _Features(rows, cols, np.zeros(dense.size, np.float32), dense.shape)
    assert not none.by_text(w).any() and not none.by_bucket(d).any()
