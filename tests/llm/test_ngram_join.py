"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from notes_engine.llm import ngram_join as nj


def slow_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def slow_components(docs):
    """{(position): (set size, least id)} by comparing all pairs."""
    sets = [slow_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), i if not sets[k] else least.get(find(k))) for k, (i, _) in enumerate(docs)]


def compare(df, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_join(df).collect()), key=str)
    assert got == sorted(slow_components(docs), key=str)


def varied(rng, n_bases=25):
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = []
    for _ in range(n_bases):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 8, 12, 30, 80, 200]))]
        if rng.random() < 0.4:
            base[2:2] = passage
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.2:
                copy = copy[: max(1, int(len(copy) * 0.85))]
            docs.append(" ".join(copy).replace("w1", "W1"))
    rng.shuffle(docs)
    return [(k * 3, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(clash, seed):
    docs = varied(random.Random(seed))
    compare(clash(docs), docs)


def test_frequent_tokens(clash, monkeypatch):
    """With nearly all tokens frequent, combinations must find every pair."""
    monkeypatch.setattr(nj, "LEAST_LOCAL", 1)
    monkeypatch.setattr(nj, "LEAST_FREQUENT", 2)
    docs = varied(random.Random(7))
    compare(clash(docs), docs)


def test_large_group_needs_rounds(clash):
    """A chain of sets in which far members don't link, all with one signature in common."""
    words = [f"v{k}" for k in range(400)]
    docs = [(k, " ".join(words[k * 4 : k * 4 + 104])) for k in range(60)]
    compare(clash(docs), docs)


def test_edges(clash):
    docs = [(5, None), (6, ""), (7, " \n"), (1, "a b"), (2, "A  b"), (3, "a b c d e"), (4, "a b c d e "), (9, "é b c d e"), (8, "É b c d e"), (None, "a b"), (11, "a b"), (11, "a b"), (12, "x " * 30_000)]
    compare(clash(docs), docs)
    assert nj.ngram_join(clash([])).count() == 0


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.op5_ngram_join(spark, sf_dir).collect())
    assert got == sorted(slow_components(docs))


def test_parity_never_excludes_similar_sets():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64))))
        if len(y) and nj.similar(x, y):
            assert nj.may_be_similar(nj.parity(x), nj.parity(y), len(x), len(y))


def test_signatures_are_shared():
    """Similar sets share a signature, whatever is frequent."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 300))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) < 0.93], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 10))).astype(np.uint64))))
        frequent = np.unique(np.concatenate((x, y)))
        frequent = frequent[rng.random(len(frequent)) < rng.choice([0, 0.3, 0.9, 1])]
        if len(y) and nj.similar(x, y) and not np.array_equal(x, y):
            assert np.intersect1d(nj.signatures(x, frequent), nj.signatures(y, frequent)).size


@pytest.mark.parametrize("percent", [5, 30, 49, 80])
def test_similar_sets_share_a_signature_at_any_percent(percent):
    """Also where all tokens are frequent and sizes are several bit lengths apart."""
    for n in range(2, 45):
        for m in range(n, min(100 * n // percent, 300) + 1):
            x, y = np.arange(1, n + 1, dtype=np.uint64), np.arange(1, m + 1, dtype=np.uint64)
            assert len(np.intersect1d(nj.signatures(x, y, percent), nj.signatures(y, y, percent))), (n, m)


def test_batches_follow_bytes(spark):
    """Long rows come in small batches while the join runs, and the session is as before after it."""
    import pyarrow as pa

    from notes_engine.llm.common import batches_of

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    df = spark.range(0, 5000, 1, 1).selectExpr("repeat('x', 2000) AS t")
    with batches_of(spark):
        assert df.mapInArrow(largest, "n long").first().n < 3_000_000
    assert spark.conf.get(key, None) == before


def test_counted_tokens():
    h = np.array([5, 3, 5, 9, 3, 5, 1], np.uint64)
    assert [x.tolist() for x in nj.repeated(h.copy(), 2)] == [[3, 5], [2, 3]]
    assert [x.tolist() for x in nj.repeated(h[:1].copy(), 2)] == [[], []]
    assert [x.tolist() for x in nj.repeated(h[:0].copy(), 2)] == [[], []]


def test_small_tables_in_few_files(spark):
    """A stored table has no file for each of many shuffle partitions."""
    from notes_engine.llm.common import gathered

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = gathered(spark.range(1000).selectExpr("id % 500 AS k").groupBy("k").count())
        assert df.rdd.getNumPartitions() == 40 and df.count() == 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_labels_of_few_rounds(spark):
    """After some rounds nodes of one label are connected; without a bound there is one label."""
    from notes_engine.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(k, k + 1) for k in range(100, 110)], "x long, y long")
    some = {r.node: r.label for r in components(links, 1).collect()}
    assert len(some) == 72 and len(set(some.values())) > 2 and all((n < 100) == (m < 100) for n, m in some.items())
    assert {r.label for r in components(links).collect()} == {0, 100}


def test_sets_are_sent_only_as_what_they_are(spark, clash, monkeypatch):
    """A pair's sets go each to its own join, and in later rounds only sets of some pair are looked at."""
    assert {tuple(r) for r in nj._ends(spark.createDataFrame([(1, 1, 2, 2), (3, 3, 2, 2), (2, 2, 4, 4)], "a long, b long, a2 long, b2 long")).collect()} == {(1, 1, True, False), (2, 2, True, True), (3, 3, True, False), (4, 4, False, True)}
    likely, verified, looked, sent = nj._likely, nj._verified, [], []
    monkeypatch.setattr(nj, "_likely", lambda pairs, nodes, percent: looked.append((nodes.count(), pairs.count())) or likely(pairs, nodes, percent))
    monkeypatch.setattr(nj, "_verified", lambda pairs, tokens, percent: sent.append((tokens.where("one").count() + tokens.where("two").count(), tokens.count())) or verified(pairs, tokens, percent))
    monkeypatch.setattr(nj, "GROWTH", 2)
    rng, words = random.Random(12), [f"v{k}" for k in range(400)]
    texts = [" ".join(words[k * 4 : k * 4 + 104]) for k in range(60)] + [" ".join(f"z{rng.randrange(10**6)}" for _ in range(50)) for _ in range(200)]
    docs = list(enumerate(texts))
    compare(clash(docs), docs)
    assert len(looked) > 1 and looked[0][0] == 260 and all(n <= 60 for n, pairs in looked[1:])
    assert all(both < 2 * n for both, n in sent if n > 2)


@pytest.mark.parametrize("leaders", [3, 64])
def test_a_pair_is_made_in_one_of_the_groups_it_shares(spark, leaders):
    """Of groups with the same members one goes on; a pair that isn't made now waits in a group that has both."""
    members, found, waits = range(1, 31), [], []
    rest = [(s, m, -m, 100, m) for s in range(40) for m in members if s >= 30 or m != s + 1]  # the last ten groups have the same members
    rest = spark.createDataFrame(rest, "sig long, a long, b long, n long, c long")
    nodes = spark.createDataFrame([(m, -m, bytes(nj.SHORT_BITS // 8)) for m in members], "a long, b long, short binary")
    left = nj._left(rest, nodes)
    assert left.select("sig").distinct().count() == 31
    for r in nj._pairs(left, leaders, nj.PERCENT).collect():
        found.append((min(r.a, r.a2), max(r.a, r.a2))) if r.first else waits.append((r.sig, r.a))
    groups = {}
    for s, m in waits:
        groups.setdefault(s, set()).add(m)
    every = {(x, y) for x in members for y in members if x < y}
    assert len(found) == len(set(found))
    assert every == set(found) | {(x, y) for x, y in every if any({x, y} <= g for g in groups.values())}
    assert leaders < 30 or set(found) == every


def test_near_copies_in_few_pairs(spark, clash, monkeypatch):
    """A group of near copies in several components: later rounds make each pair once, and no link is lost."""
    pairs, made = nj._pairs, []

    def counted(postings, leaders, percent):
        out = pairs(postings, leaders, percent)
        if leaders > nj.LEADERS:
            made.append([(r.a, r.b, r.a2, r.b2) for r in out.where("first").collect()])
        return out

    monkeypatch.setattr(nj, "_pairs", counted)
    monkeypatch.setattr(nj, "GROWTH", 4)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(150)]
    docs = [(k, " ".join(x if rng.random() > 0.012 else f"z{rng.randrange(10**6)}" for x in base)) for k in range(150)]
    compare(clash(docs), docs)
    assert made and all(len(x) == len(set(x)) for x in made)
