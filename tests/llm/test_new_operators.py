"""Fingerprints, importance resampling and vector codes against plain Python; edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from notes_engine.llm import target_resampling, vector_codes, weighted_fingerprints
from notes_engine.llm.byte_words import LETTERS, Words, crc32_after

LONG = "word " * 30_000 + "x" * 50_000
TEXTS = ["the quick brown fox jumps over the lazy dog again and again", "The Quick brown fox jumps over the lazy dog again and again", "", None, " \t", "wörter über öl 日本語 🙂 x1 y2", "a", "a b", LONG, "a", "a b c d e a b c d e"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def bag(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w]
    out = Counter((w,) for w in words)
    out.update([tuple(["s", *words])] if 0 < len(words) < 5 else [("s", *words[k : k + 5]) for k in range(len(words) - 4)])
    return out


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


# fingerprints


def test_samples_collide_as_often_as_the_generalised_jaccard_similarity_says():
    rng = np.random.default_rng(5)
    got, true = [], []
    for _ in range(300):
        terms = rng.integers(1, 2**62, 40).astype(np.uint64)
        a, b = rng.integers(1, 12, 40).astype(float), rng.integers(1, 12, 40).astype(float)
        x, y = (weighted_fingerprints.weighted_samples(terms, w).min(axis=0) & np.uint64(0xFFFFFFFF) for w in (a, b))
        got.append((x == y).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(got) - np.mean(true)) < 0.01
    terms = rng.integers(1, 2**62, 500).astype(np.uint64)
    assert np.array_equal(weighted_fingerprints.weighted_samples(terms, np.ones(500)), weighted_fingerprints.unit_samples(terms))


def test_fingerprints_estimate_the_similarity_of_texts(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    others = [weighted_fingerprints.edited(a, b) for a, b in zip(texts, [*texts[1:], texts[0]], strict=True)]
    own, other = weighted_fingerprints.fingerprints(pa.array(texts), pa.array(others))
    assert np.array_equal(own, weighted_fingerprints.fingerprints(pa.array(texts))[0])
    assert np.array_equal(other, weighted_fingerprints.fingerprints(pa.array(others))[0])
    apart = weighted_fingerprints.likeness(own, other) - [jaccard(bag(a), bag(b)) for a, b in zip(texts, others, strict=True)]
    assert abs(apart.mean()) < 0.015 and apart.std() < 0.08


def fingerprint_rows(rows):
    """Ids, edited digests and whether the next text is the same, by plain Python; rows are (id, text)."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 4
        out.append((i, len(t), sha(t[: len(t) - n] + following[:n])))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_edits_follow_the_order_of_ids(spark, clash, partitions):
    rows = [((7 * k) % 11 * 10, t) for k, t in enumerate(TEXTS)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = weighted_fingerprints.fingerprint_edits(clash(rows).repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == fingerprint_rows(rows)
    by_id, text_of = {r.doc_id: r for r in got}, {i: t or "" for i, t in rows}
    ids = sorted(by_id)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        r = by_id[i]
        changed = weighted_fingerprints.edited(text_of[i], text_of[j])
        same = lambda x, y: np.mean([x[8 * k : 8 * k + 8] == y[8 * k : 8 * k + 8] for k in range(64)])
        assert r.near_next == same(r.fingerprint, by_id[j].fingerprint) and r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        assert abs(r.near_edited - jaccard(bag(text_of[i]), bag(changed))) < 0.3
    prints = {}
    for i in ids:
        assert prints.setdefault(lower(text_of[i]), by_id[i].fingerprint) == by_id[i].fingerprint


def test_edits_of_repeated_null_and_single_ids(spark, make_docs):
    assert weighted_fingerprints.fingerprint_edits(make_docs([]).limit(0)).count() == 0
    one = weighted_fingerprints.fingerprint_edits(make_docs([(5, "abcdefgh")])).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(5, sha("abcdefab"), 1.0)]
    many = weighted_fingerprints.fingerprint_edits(make_docs([(1, "same text")] * 40 + [(None, "other"), (None, "one more")]).repartition(5)).collect()
    assert len(many) == 42 and Counter(r.doc_id for r in many) == {1: 40, None: 2}
    assert sum(r.near_next == 1.0 for r in many) == 39


# importance resampling


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def features(t):
    w = words(t)
    return [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def resampled(docs, target):
    """By plain Python; docs are (id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = {}
    for i, x in docs:
        found = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000.0) / ((s[b] + 1.0) * (t_all + 10_000.0)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    can = [i for i, x in docs if len(words(x)) >= 20]
    for rank, i in enumerate(sorted(can, key=lambda i: (-out[i][2], i))[: 5 * len(can) // 100], 1):
        out[i][3] = rank
    return sorted((i, *v) for i, v in out.items())


def test_words_and_checksums_by_bytes():
    w = Words(pa.array([x or "" for x in TEXTS]), LETTERS)
    wanted = [x.encode() for t in TEXTS for x in words(t)]
    assert [w.data[b : b + n].tobytes() for b, n in zip(w.begin.tolist(), w.size.tolist(), strict=True)] == wanted
    crc = w.crc32()
    assert crc.tolist() == [zlib.crc32(x) for x in wanted]
    assert (crc32_after(crc[:-1], w.size[1:]) ^ crc[1:]).tolist() == [zlib.crc32(x + y) for x, y in zip(wanted, wanted[1:], strict=False)]


def test_resampling_of_the_tables(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").collect()]
    wanted = resampled(docs, [r.text for r in read("benchmark").collect()])
    got = target_resampling.op12_target_resampling(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == wanted and any(r[4] for r in wanted)


def test_resampling_with_odd_rows(spark, clash, make_docs):
    twenty = " ".join(f"w{k}" for k in range(20))
    docs = [*enumerate(TEXTS), *[(k, twenty) for k in range(20, 60)], (60, twenty + " target words"), (61, LONG)]
    got = target_resampling.resample(clash(docs), make_docs(["target words", None])).collect()
    assert sorted(tuple(r) for r in got if r.rank) == sorted(r for r in resampled(docs, ["target words", None]) if r[4])
    assert sorted(tuple(r)[:4] for r in got) == [r[:4] for r in resampled(docs, ["target words", None])]
    repeated = target_resampling.resample(make_docs([(7, twenty)] * 100 + [(None, twenty)] * 3), make_docs([])).collect()
    assert len(repeated) == 103 and sorted(r.rank for r in repeated if r.rank) == [1, 2, 3, 4, 5]
    assert target_resampling.resample(make_docs([]).limit(0), make_docs([]).limit(0)).count() == 0


def test_cut_off_among_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(-3, 3)), int(rng.integers(0, 40)) if k % 9 else None, k) for k in range(400)]
    table = spark.createDataFrame(rows, "score long, doc_id long, row long")
    ordered = sorted(rows, key=lambda r: (-r[0], 2**63 if r[1] is None else r[1], r[2]))
    for k in (0, 1, 37, 200, 399, 400):
        assert sorted(r.row for r in table.where(target_resampling.drawn(table, k)).collect()) == sorted(r[2] for r in ordered[:k])
    order = [target_resampling.F.desc("score"), target_resampling.F.asc_nulls_last("doc_id"), target_resampling.F.asc("row")]
    assert [r.row for r in target_resampling.ranked(table, order).orderBy("rank").collect()] == [r[2] for r in ordered]


# vector codes


@pytest.mark.parametrize(("entries", "width", "span"), [(64, 4, 40), (1, 3, 9), (7, 1, 3), (64, 2, 2), (50, 9, 1000)])
def test_orchard_search_is_exact(entries, width, span):
    rng = np.random.default_rng(entries)
    book, points = rng.integers(-span, span, (entries, width)), rng.integers(-2 * span, 2 * span, (3000, width))
    index, error = vector_codes.Orchard(book).nearest(points)
    apart = ((points[:, None] - book[None]) ** 2).sum(axis=-1)
    assert np.array_equal(index, apart.argmin(axis=1)) and np.array_equal(error, apart.min(axis=1))


def compressed(rows, entries=64):
    """By plain Python: rows are (id, vector, label), all vectors of one length that 16 divides."""
    kept = sorted((i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    size = len(kept[0][1]) // 16
    cut = [(i, [v[size * p : size * (p + 1)] for p in range(16)], label) for i, v, label in kept]
    books = [[v[p] for _, v, _ in cut[:entries]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(2):
        for p, book in enumerate(books):
            own = [(near(v[p], book)[1], v[p]) for _, v, _ in cut]
            for e in range(len(book)):
                mine = [x for f, x in own if f == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, [near(v[p], books[p]) for p in range(16)], label) for i, v, label in cut]
    total = Counter()
    for _, n, label in found:
        total[label] += sum(d for d, _ in n)
    digest = sha(",".join(str(x) for book in books for c in book for x in c))
    return [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), total[label], digest) for i, n, label in found]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_codes_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=32))], [None, 1, 2][k % 3]) for k in range(150)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(30)]  # a common vector
    odd = [(-1, None, 1), (-2, [None, *[0.0] * 31], 1), (-3, [math.nan, *[0.0] * 31], 2), (-4, [math.inf] * 32, 2)]
    table = vectors(spark, [*rows, *odd]).selectExpr("*", "7 AS code", "7 AS error", "'x' AS _told", "1 AS at").repartition(5)
    got = vector_codes.compress(table).collect()
    assert sorted(tuple(r) for r in got) == compressed(rows)


def test_codes_of_few_none_and_uneven_vectors(spark):
    few = [(k, [k / 7.0] * 16, None) for k in range(3)]
    assert sorted(tuple(r) for r in vector_codes.compress(vectors(spark, few)).collect()) == compressed([(i, [float(np.float32(x)) for x in v], label) for i, v, label in few])
    assert vector_codes.compress(vectors(spark, [])).count() == 0 and vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0
    uneven = [(1, [1.0] * 20, 1), (2, [], 1), (2, [], 1), (None, [2.0] * 5, None)]
    full = [(i if i is not None else 9, [*v, *[0.0] * (32 - len(v))], label) for i, v, label in uneven]
    got = vector_codes.compress(vectors(spark, uneven)).collect()
    assert sorted((r.vec_id or 9, *tuple(r)[1:]) for r in got) == compressed(full)
    with pytest.raises(ValueError, match="256"):
        vector_codes.compress(vectors(spark, few), entries=257)


def test_codes_of_the_table_and_their_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    wanted = compressed(rows)
    assert sorted(tuple(r) for r in vector_codes.op13_vector_codes(spark, sf_dir).collect()) == wanted
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    assert sorted(con.execute(f"SELECT {columns} FROM ({vector_codes.ORACLE_SQL})").fetchall()) == wanted
