"""Token counts, packing and token files, against the tokenizers library and exact round trips."""

import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from notes_engine.llm import packing, pfor, token_counts, token_files
from notes_engine.llm.tokens import DEFAULT_VOCABULARY, Encoder, run_of

LIBRARY = Tokenizer.from_file(DEFAULT_VOCABULARY)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def texts():
    rng = random.Random(11)
    parts = ["the", "Wörter", "naïve", "it's", "we'LL", "12345", "?!", "...", "\n", "\n\n", "\t", " ", "  ", " ", "　", "\x1c", "\x85", "日本語", "\U0001f600\U0001f601", "é", "<|endoftext|>", "<|end", "'s", "_x_", "a" * 40, "\r\n", "\x00"]
    made = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(30))) for _ in range(150)]
    return [None, "", " ", "  ", " a", "a ", "a  b", "a <|endoftext|> b", *made, "x" * 20_000, "ab " * 20_000, " " * 5000]


def test_run_of_keeps_the_text():
    for t in texts():
        assert "".join(run_of(t or "")) == (t or "")


def test_encoder_is_the_library():
    given = [t or "" for t in texts()]
    for got, t in zip(Encoder(DEFAULT_VOCABULARY).encode(given), given, strict=True):
        assert got.tolist() == ids_of(t), t


def test_token_counts(clash):
    given = texts()
    rows = {r.doc_id: r for r in token_counts.count_tokens(clash(given)).collect()}
    assert len(rows) == len(given)
    for k, t in enumerate(given):
        n = len(ids_of(t))
        assert (rows[k].n_tokens, rows[k].n_bytes, rows[k].over_limit) == (n, len((t or "").encode()), n > 512), t


def test_token_counts_of_documents(spark, sf_dir):
    got = {r.doc_id: r.n_tokens for r in token_counts.op1_token_counts(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert got[r.doc_id] == len(ids_of(r.text))


def test_count_merged_prefers_low_ranks_then_left():
    a, b, c = b"a", b"b", b"c"
    assert token_counts.count_merged([a, a, a], {(a, a): 0}) == 2
    assert token_counts.count_merged([a, b, c], {(b, c): 0, (a, b): 1}) == 2
    assert token_counts.count_merged([a, b, c], {(b, c): 0, (a, b"bc"): 1}) == 1
    assert token_counts.count_merged([], {}) == 0


# packing


def check_packing(rows, docs, limit=2048):
    """Each id in exactly one piece, sequences gapless; returns padding as a part of all ids."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for key, text in docs.items():
        ids, at = [*ids_of(text), 1], 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
        total += at
        pad += 0 if math.log2(at).is_integer() else limit - at
    return pad / max(total, 1)


def test_packing_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_packing(packing.op6_packing(spark, sf_dir).collect(), docs) < 0.01


def test_packing_edges(clash):
    given = dict(enumerate(texts()))
    out = packing.pack(clash(list(given.items())))
    rows = out.collect()
    check_packing(rows, given)
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(clash([(None, "a"), (None, "a")])).count() == 2
    assert packing.pack(clash([])).count() == 0


def slow_cost(places, costs, cuts, limit):
    total, last = 0.0, 0
    for c in cuts:
        length = c - last
        assert 0 < length <= limit
        total += costs[places.index(c)] + packing.SEQUENCE_COST
        total += 0 if length >= packing.LEAST_POWER and math.log2(length).is_integer() else limit - length
        last = c
    assert last == places[-1]
    return total


def test_best_cuts_are_best():
    rng = random.Random(2)
    limit = 256
    for _ in range(60):
        places = [0]
        for _ in range(rng.randrange(1, 40)):
            places.append(places[-1] + rng.randrange(1, limit))
        costs = [0.0] + [float(rng.choice([0, 2, 24])) for _ in places[1:]]
        best = [0.0] + [math.inf] * (len(places) - 1)
        for k in range(1, len(places)):
            for j in range(k):
                n = places[k] - places[j]
                if n <= limit:
                    pad = 0 if n >= packing.LEAST_POWER and math.log2(n).is_integer() else limit - n
                    best[k] = min(best[k], best[j] + pad + costs[k] + packing.SEQUENCE_COST)
        assert slow_cost(places, costs, packing.best_cuts(places, costs, limit), limit) == pytest.approx(best[-1])


# token files


@pytest.mark.parametrize("n", [0, 1, 7, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 65536, 1 << 32])
def test_pfor_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    few = ids.copy()
    few[rng.random(n) < 0.95] = 5  # a narrow block with exceptions
    for a in (ids, few):
        packed = pfor.encode(a)
        assert np.array_equal(pfor.decode(packed), a)
        for start, stop in [(0, 1), (n // 3, n // 2), (n - 1, n), (3, n + 9)]:
            assert np.array_equal(pfor.decode(packed, max(start, 0), stop), a[max(start, 0) : stop])


def test_pfor_is_smaller():
    ids = np.random.default_rng(0).integers(0, 200, 100_000).astype(np.uint32)
    ids[::100] = 50_000
    assert len(pfor.encode(ids)) < 0.3 * ids.nbytes


def check_files(rows, docs):
    at = 0
    for key, r in zip(sorted(docs), sorted(rows, key=lambda r: r.doc_id), strict=True):
        ids = [*ids_of(docs[key]), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_files(token_files.op7_token_files(spark, sf_dir).collect(), docs)


def test_token_files_edges(spark, clash, tmp_path):
    given = {3 * k - 5: t for k, t in enumerate(texts())}
    token_files.write_token_files(clash(list(given.items())), f"file://{tmp_path}/a")
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/a").collect()
    check_files(rows, given)
    assert all(r.ids[-1] == 0 and len(r.ids) == r.n_tokens for r in rows)
    token_files.write_token_files(clash([(None, "a b"), (4, None), (4, None), (None, "c")]), f"file://{tmp_path}/b")
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/b").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 4, 4] and [r.start for r in rows][2:] == [5, 6]
    token_files.write_token_files(clash([]), f"file://{tmp_path}/c")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/c").count() == 0


def test_counts_are_those_of_the_ids():
    import pyarrow as pa

    column = pa.array([t or "" for t in texts()], pa.string())
    encoder = Encoder(DEFAULT_VOCABULARY)
    for _ in range(2):  # the second time from memory
        assert encoder.count_all(column).tolist() == encoder.encode_all(column)[1].tolist() == [len(ids_of(t)) for t in texts()]
    assert encoder.count_all(column[:0]).tolist() == []


def test_pieces_are_remembered_together(monkeypatch):
    """The memory takes up many pieces without a Python call for each, and drops the older generation."""
    import sys

    from notes_engine.llm import tokens

    made = []
    memory = tokens.Remembered(lambda words: made.extend(words) or [w.upper() for w in words], len)
    words, calls = [f"w{k}" for k in range(500)] + ["y" * 300], []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        got = memory.values(words)
    finally:
        sys.setprofile(None)
    assert got == [w.upper() for w in words] and len(calls) < 550  # one for each upper-cased word at most
    assert memory.values(words) == got and made == [*words, words[-1]]  # the long one is made each time
    monkeypatch.setattr(tokens, "CACHE_BYTES", 0)
    assert memory.values(words[:3]) == got[:3] and memory.values(["w9"]) == ["W9"] and made[502:] == ["w9"]


def test_what_is_remembered_has_a_bound_of_its_own():
    from notes_engine.llm import tokens

    made = []
    memory = tokens.Remembered(lambda words: made.extend(words) or [1] * len(words), most=1000)
    for k in range(50):
        memory.values([f"w{k}", f"v{k}"])
        assert memory.held <= 1000 and len(memory.known) + len(memory.older) <= 8
    assert len(made) == 100
    assert Encoder(DEFAULT_VOCABULARY).counts.most < tokens.CACHE_BYTES
