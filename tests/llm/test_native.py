"""Operators that run on DataFrame functions only, against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from notes_engine.llm import exact_dedup as ed
from notes_engine.llm import license_scan as ls
from notes_engine.llm import quality_rules as qr
from notes_engine.llm import secret_scan as ss

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "[\x20\x09-\x0d]+"


def words(text, gap=SPACE):
    return [w for w in re.split(gap, text or "") if w]


# exact dedup


def test_exact_dedup_groups(clash):
    docs = [(3, "Aé"), (1, "aé"), (2, "aÉ"), (5, None), (4, ""), (9, "x" * 100_000), (8, "X" * 100_000), (None, "AÉ"), (7, "b"), (7, "b")]
    rows = {(r.doc_id, r.text_sha256): r for r in ed.exact_dedup(clash(docs), keep="max").collect()}
    assert len(rows) == 9
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (rows[1, sha("aé")].keep_id, rows[1, sha("aé")].group_size, rows[1, sha("aé")].kept) == (3, 2, False)
    assert rows[2, sha("aÉ")].kept and rows[2, sha("aÉ")].group_size == 2
    assert rows[None, sha("aÉ")].keep_id == 2 and not rows[None, sha("aÉ")].kept
    assert rows[4, sha("")].keep_id == 5 and rows[8, sha("x" * 100_000)].keep_id == 9
    assert rows[7, sha("b")].kept and rows[7, sha("b")].group_size == 2


@pytest.mark.parametrize(("keep", "ids"), [("max", [3, 5, 7, None]), ("min", [1, 5, 7, None])])
def test_keep_one(clash, keep, ids):
    docs = clash([(3, "A"), (1, "a"), (5, "c"), (None, "C"), (7, "b"), (7, "b"), (None, "z"), (None, "Z")])
    out = ed.keep_one(docs, keep=keep)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x)) == ids


def test_exact_dedup_empty(make_docs):
    assert ed.exact_dedup(make_docs([])).count() == 0
    assert ed.keep_one(make_docs([])).count() == 0


# quality rules


def measured(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if c[g] >= 2 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def quality_texts():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a b c d e", "a b c d e a b c d e", "a a a a a a", "one\ntwo\none\n\n \none", "# $ é\x0bü é\r\n| <b>", "x " * 3000]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", "c é"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(60))))
    return texts


def test_quality_measures(clash):
    texts = quality_texts()
    rows = {r.doc_id: r for r in qr.ledger(clash(texts), keep_cols=("kept", "n_chars")).collect()}
    assert len(rows) == len(texts) and rows[0].kept == 7
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(t), t


def test_policies_and_ablation(make_docs):
    good = " ".join(f"word{i}" for i in range(20))
    led = qr.ledger(make_docs([good, good + "".join(f" ${i}" for i in range(9)), "few", None, "$ $"]))
    assert [r.ok for r in led.orderBy("doc_id").select(qr.passes(qr.BASE).alias("ok")).collect()] == [True, True, False, False, False]
    assert [r.ok for r in led.orderBy("doc_id").select(qr.passes(qr.FULL).alias("ok")).collect()] == [True, False, False, False, False]
    rows = {r.rule: r for r in qr.ablation(led, qr.FULL).collect()}
    assert (rows["few_words"].n_failed, rows["few_words"].n_only, rows["few_words"].n_kept_without, rows["few_words"].n_docs) == (3, 2, 3, 5)
    assert (rows["symbols"].n_failed, rows["symbols"].n_only, rows["symbols"].n_kept_without) == (2, 1, 2)
    assert {r.n_docs for r in qr.ablation(led.limit(0), qr.FULL).collect()} == {0}


# licence scans


def license_texts():
    return [
        None, "", "Under the MIT License.", "x under the mit-license under THE mit license; under the mit", "under the the mit license",
        "Apache License, Version 2.0 and CC BY-NC 4.0, cc-by-nc", "cc by sa", "Licensed under the GNU General Public License, version 3.",
        "Éunder the mit license under the mit license", "license " * 500 + "under the mit license " * 200, "mit license under the",
    ]


def test_license_base(clash):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = license_texts()
    rows = {r.doc_id: r for r in ls.scan_licenses(clash(texts)).collect()}
    for k, t in enumerate(texts):
        w = words((t or "").translate(AZ), "[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert rows[k].n_words == len(w)
        assert sorted((m.start, m.label) for m in rows[k].matches if m.base) == places, t
        assert all(0 < m.score <= 1 for m in rows[k].matches) and all(m.score == 1 for m in rows[k].matches if m.base)
    assert {m.label for m in rows[7].matches} == {"gpl"} and {m.label for m in rows[6].matches} == {"cc-by-sa"}


def test_reworded_license(make_docs):
    bsd = next(t for t in ls.TEMPLATES if t.label == "bsd")
    texts = [bsd.text, bsd.text.replace("provided that the following conditions are met", "if these conditions are kept"), bsd.text.replace("binary forms", "binary shapes")]
    rows = [r.matches for r in ls.scan_licenses(make_docs(texts)).orderBy("doc_id").collect()]
    assert [[m.label for m in r] for r in rows] == [["bsd"], ["bsd"], []]
    assert rows[0][0].score == 1 and 0.5 < rows[1][0].score < 1


def test_files_look_up_their_own_rarest_words(make_docs):
    """Of one licence, two files that have different words of it look up different words; each wording is found, whole and reworded."""
    gpl = next(t for t in ls.TEMPLATES if t.label == "gpl" and "redistribute" in t.text)
    head, tail = gpl.text.split(gpl.key)
    common = " ".join(["this program is free software under the terms as published by"] * 3)
    texts = [gpl.text, gpl.key + tail, head + gpl.key, *[common] * 40, *["gnu general public license"] * 20, *["free software foundation"] * 30]
    rows = [[m for m in r.matches if m.template == ls.TEMPLATES.index(gpl)] for r in ls.scan_licenses(make_docs(texts)).orderBy("doc_id").collect()]
    assert [len(r) for r in rows[:4]] == [1, 1, 1, 0] and rows[0][0].score == 1 and rows[0][0].start == 0 and rows[1][0].start == -len(head.split())
    words = [sorted(set(x.split()) & set(gpl.words)) for x in texts]
    counts = Counter(w for x in words for w in x)
    looked = [sorted(words[k], key=lambda w: (counts[w], w))[: ls.LOOKED_UP] for k in range(3)]
    assert looked[1] != looked[2]  # tail's words in one, head's in the other
    for k in range(3):
        rarest_key = min(gpl.key_words, key=lambda w: (counts[w], w))
        place = rows[k][0].start
        here = texts[k].split()
        assert rows[k][0].votes == sum(any(0 <= place + j < len(here) and here[place + j] == w for j, x in enumerate(gpl.words) if x == w) for w in {*looked[k], rarest_key})


@pytest.mark.parametrize("k", range(len(ls.TEMPLATES)))
def test_every_wording_is_found_whole_and_reworded(k):
    """By plain Python: key phrases stand in their wordings, and no wording repeats another's text."""
    t = ls.TEMPLATES[k]
    assert t.words[t.key_at : t.key_at + len(t.key_words)] == t.key_words and all(t.text != o.text for o in ls.TEMPLATES if o is not t)


def test_wordings_in_texts(make_docs):
    texts = [x for t in ls.TEMPLATES for x in (f"Copyright 2020. {t.text.title()}.", " ".join(w if t.key_at <= j < t.key_at + len(t.key_words) else f"{w}s" for j, w in enumerate(t.words)))]
    rows = [r.matches for r in ls.scan_licenses(make_docs(texts)).orderBy("doc_id").collect()]
    for k, t in enumerate(ls.TEMPLATES):
        whole, reworded = ([m for m in rows[2 * k + j] if m.template == k] for j in range(2))
        assert [(m.start, m.score, m.label) for m in whole] == [(2, 1.0, t.label)]
        assert [m.start for m in reworded] == [0] and (reworded[0].score < 1 or t.key == t.text)


def test_license_very_long_text(clash):
    text = "the license " * 20_000 + "Under the MIT License. " + "permission granted " * 20_000
    (row,) = ls.scan_licenses(clash([text])).collect()
    assert [(m.label, m.start, m.score) for m in row.matches] == [("mit", 40_000, 1.0)]


def test_license_empty(make_docs):
    assert ls.scan_licenses(make_docs([])).count() == 0


# secret scans


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secret_texts():
    rng = random.Random(3)
    parts = ["token: token: abcdefgh", "pass\U0001f600word", "PassWord = 'abc123+/='", "api_key=short", "apikey:\"longer-value.1\"", "AKIA" + "Z9" * 10, "AKIAAKIA" + "0" * 14,
             "deadbeef" * 4, "f" * 23, "é", "\U0001f600", " ", "secret  :  token=abcdef", "\n", "AKIA" + "a" * 30, "0123456789abcdef01234567", "token = \"" + "ab12" * 10 + "\""]
    texts = [None, "", "secret", *("".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(1, 12))) for _ in range(80))]
    return [*texts, " ".join("deadbeef" * 3 for _ in range(3000))]


def test_secret_base(clash):
    texts = secret_texts()
    rows = {r.doc_id: r.spans for r in ss.scan_secrets(clash(texts)).collect()}
    for k, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in rows[k] if s.kind < 3] == base_spans(t or ""), t
        assert all((t or "")[s.start : s.end] == s.value for s in rows[k])


def entropy(value):
    best = 0.0
    for i in range(len(value) - 19):
        c = Counter(value[i : i + 20])
        best = max(best, -sum(n / 20 * math.log2(n / 20) for n in c.values()))
    return best


def test_window_entropy(spark):
    rng = random.Random(1)
    values = ["a" * 30, "ab" * 20, "".join(rng.choice(ss.ALPHABET) for _ in range(400)), "".join(rng.choice("0123456789abcdef") for _ in range(64)), ss.ALPHABET]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", ss.window_entropy(df.v).alias("h")).collect():
        assert r.h == pytest.approx(entropy(r.v), abs=1e-9)


def test_entropy_spans(make_docs):
    random_key = "q7Zp3LxV9tBf2KmN8sRw5YdHc4Jg"
    texts = [f"key {random_key} here", "id 1234567890123456789012", "example-" + random_key, "thisisoneverylongwordofletters", "DEADBEEF0192837465ACFB10", f"token={random_key}"]
    rows = [[ss.KINDS[s.kind] for s in r.spans] for r in ss.scan_secrets(make_docs(texts)).orderBy("doc_id").collect()]
    assert rows == [["entropy"], [], [], [], ["entropy"], ["assign"]]


def plain_spans(text):
    """Base spans, and candidates outside of them of which a part, between harmless ones, isn't allowed as a whole and has an entropy that is high enough."""
    base = base_spans(text)
    more = []
    for m in re.finditer(ss.CANDIDATE, text):
        inside = any(s <= m.start() and m.end() <= e for s, _, e in base)
        bits = lambda v: ss.MIN_BITS["hex" if re.fullmatch("[0-9a-fA-F]+", v) else "base64"]
        allowed = lambda v: any(re.search(p, v) for p in ss.ALLOWED)
        left = re.sub(ss.FILLER, " ", re.sub(ss.HARMLESS, " ", m[0])).split(" ")
        if not inside and not allowed(m[0]) and any(len(v) >= 20 and not allowed(v) and entropy(v) >= bits(v) - 1e-9 for v in left):
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def told(spans):
    return ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_op3_against_plain_python(spark, sf_dir, tmp_path, make_docs):
    """The registered query, on documents and on texts full of candidates."""
    rng = random.Random(9)
    runs = ["".join(rng.choice(ss.ALPHABET[: rng.choice([16, 36, 67])]) for _ in range(rng.randrange(15, 90))) for _ in range(60)]
    texts = secret_texts() + [" ".join(rng.sample(runs, 4)) for _ in range(60)] + ["".join(rng.choice(ss.ALPHABET) for _ in range(20_000))]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    n = 0
    for d in (sf_dir, str(tmp_path)):
        wanted = {r.doc_id: plain_spans(r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        rows = ss.op3_secret_scan(spark, d).collect()
        assert sorted(r.doc_id for r in rows) == sorted(wanted)
        for r in rows:
            base, spans = wanted[r.doc_id]
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
            assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest() and r.spans == told(spans)
            n += len(spans) - len(base)
    assert n > 50


def test_allowed_parts_hide_no_other_part(make_docs):
    """A key on both sides of an allowed form; random runs of any length, in which allowed forms occur by chance."""
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice(ss.ALPHABET[:62]) for _ in range(n))
    texts = [key(28) + "xXXx" + key(28), key(45) + "dummy" + key(45), key(10) + "EXAMPLE" + key(12), "x" * 60, key(100_000) + "xXXx0123456789example" + key(100_000), key(28) + "0123456789"]
    rows = [[(s.start, s.end) for s in r.spans] for r in ss.scan_secrets(make_docs(texts)).orderBy("doc_id").collect()]
    assert rows == [[(0, 60)], [(0, 95)], [], [], [(0, len(texts[4]))], [(0, 38)]]


def test_a_very_long_run_takes_time_in_proportion(make_docs):
    """Counts change at two places a character: a run of a million takes seconds."""
    rng = random.Random(9)
    docs = make_docs(["".join(rng.choices(ss.ALPHABET[:62], k=1_000_000))])
    began = time.perf_counter()
    assert len(ss.scan_secrets(docs).first().spans) == 1
    assert time.perf_counter() - began < 30


def test_secret_empty(make_docs):
    assert ss.scan_secrets(make_docs([])).count() == 0
