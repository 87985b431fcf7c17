"""Document fingerprints by consistent weighted sampling.

A text is a bag of weighted terms: its shingles of WORDS words (fewer words: all
as one) and its words, each of which weighs as many as its places. For each of
SAMPLES samples and each term, r and c from Gamma(2, 1) and b from [0, 1) come
from a hash of term and sample. A term of weight s has the step
t = floor(ln s / r + b) and the value a = c exp(-r (t - b + 1)); the sample is the
(term, t) of least value. Two texts have the same sample with the probability of
their generalised Jaccard similarity, sum of least weights over sum of greatest.

How r, c and b are drawn: if e0 to e2 are independent and exponential, then
c = e0 + e1 is Gamma(2, 1), e0 / c is uniform and independent of it, so that
x = ln (c / e0) is exponential; r = x + e2 is Gamma(2, 1), and b = e2 / r uniform and
independent of r and c. A weight of 1 has t = 0 and a = c exp(-x) = e0, so that such
a term, as most are, takes one hash, whose upper half is its place in the order
of a; others' values are brought to the same scale.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.byte_words import NO_SPACE, Words
from notes_engine.llm.tokens import in_groups

SAMPLES, WORDS = 64, 5
#: Terms that are sampled together, so that what is worked on stays in a core's cache; and those that are looked up together.
AT_ONCE, LOOKED_UP = 1 << 9, 1 << 14
#: Bytes of texts that are worked on together.
GROUP = 500_000
_NONE = np.iinfo(np.uint64).max


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _u(32))
    h *= _u(0xD6E8FEB86659FD93)
    h ^= h >> _u(29)
    h *= _u(0xBF58476D1CE4E5B9)
    h ^= h >> _u(32)
    return h


_SEEDS = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _u(0x9E3779B97F4A7C15)) | _u(1)


def unit_samples(terms: np.ndarray) -> np.ndarray:
    """(term, sample) of terms of weight 1: the value's place in the order of values in the upper 32 bits, in the lower what names (term, 0)."""
    h = terms[:, None] * _SEEDS[None, :]
    h ^= h >> _u(32)
    h *= _u(0xBF58476D1CE4E5B9)
    h ^= h >> _u(29)
    h *= _u(0x94D049BB133111EB)
    return h


def weighted_samples(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The same for terms of any weight."""
    unit = unit_samples(terms)
    uniform = lambda h: ((h >> _u(11)).astype(np.float64) + 0.5) * 2.0**-53
    other = _mixed(unit + _u(1))
    e0 = -np.log1p(-((unit >> _u(32)).astype(np.float64) + 0.5) * 2.0**-32)
    e1, e2 = -np.log(uniform(other)), -np.log(uniform(_mixed(other)))
    c = e0 + e1
    x = np.log(c / e0)
    r = x + e2
    t = np.floor(np.log(weights)[:, None] / r + e2 / r)
    a = c * np.exp(e2 - r * (t + 1))
    place = np.minimum(-np.expm1(-a) * 2.0**32, 2.0**32 - 1).astype(np.uint64)
    name = (unit & _u(0xFFFFFFFF)) ^ (_mixed(t.astype(np.int64).view(np.uint64)) >> _u(32))
    return np.where(t == 0, unit, place << _u(32) | name)


def term_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, term), a row per place where a term stands. Words stand between ASCII white space, with A-Z in lower case."""
    words = Words(texts, NO_SPACE)
    start = np.full(len(words.begin), 0x84222325CBF29CE4, np.uint64)
    w = _mixed(words.folded(start, lambda h, byte: (h ^ byte) * _u(0x100000001B3), xxhash.xxh64_intdigest))
    n = np.diff(words.bounds)
    text = np.repeat(np.arange(len(n)), n)
    run = w[: max(0, len(w) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        run = _mixed(run) + w[k : k + len(run)]
    whole = text[WORDS - 1 :] == text[: len(run)]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    short = np.array([xxhash.xxh64_intdigest(w[words.bounds[k] : words.bounds[k + 1]].tobytes()) for k in few], np.uint64)
    return np.concatenate((text[: len(run)][whole], few, text)), np.concatenate((_mixed(run[whole] + _u(1)), short, _mixed(w)))


def fingerprints(texts: pa.Array, others: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, sample), 32 bits each, of texts and of as many others; zeros for a text without words.

    What a text and its other share is sampled once: a term is kept by whether
    the text (1), the other (2) or both (3) have it with that weight.
    """
    n = len(texts)
    of, term = term_rows(texts if others is None else pa.concat_arrays([texts, others]))
    pair = of % max(n, 1)
    order = np.argsort(_mixed(term + _mixed(pair.astype(np.uint64))))  # equal terms of a pair stand together
    of, pair, term = of[order], pair[order], term[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (pair[1:] != pair[:-1]))))
    if not len(first):
        return np.zeros((n, SAMPLES), np.uint32), np.zeros((n, SAMPLES), np.uint32)
    whole = np.diff(np.append(first, len(term)))
    one = np.add.reduceat((of < n).astype(np.int64), first)
    two = whole - one
    pair, term = pair[first], term[first]
    same = one == two
    sides = [np.flatnonzero(m) for m in (~same & (one > 0), ~same & (two > 0), same)]
    group = np.concatenate([pair[m] * 4 + k for k, m in enumerate(sides, 1)])
    term, weight = term[np.concatenate(sides)], np.concatenate((one[sides[0]], two[sides[1]], one[sides[2]]))
    out = np.full((4, n, SAMPLES), _NONE)
    order = np.argsort(group.astype(np.uint16) if 4 * n <= 1 << 16 else group, kind="stable")
    group, term, weight = group[order], term[order], weight[order]
    for unit in (True, False):
        some = (weight == 1) == unit
        g, t, s = group[some], term[some], weight[some]
        step = AT_ONCE if unit else LOOKED_UP
        for a in range(0, len(t), step):
            part = slice(a, a + step)
            values = unit_samples(t[part]) if unit else _looked_up(t[part], s[part])
            begins = np.flatnonzero(np.concatenate(([True], g[part][1:] != g[part][:-1])))
            at = g[part][begins]
            least = np.minimum.reduceat(values, begins, axis=0)
            out[at % 4, at // 4] = np.minimum(out[at % 4, at // 4], least)
    return tuple(_names(np.minimum(out[k], out[3])) for k in (1, 2))


def _looked_up(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """weighted_samples() where terms repeat: each distinct term and weight is sampled once."""
    _, first, back = np.unique(terms ^ _mixed(weights.astype(np.uint64)), return_index=True, return_inverse=True)
    made = [weighted_samples(terms[first[a : a + AT_ONCE]], weights[first[a : a + AT_ONCE]]) for a in range(0, len(first), AT_ONCE)]
    return np.concatenate(made)[back]


def _names(least: np.ndarray) -> np.ndarray:
    return np.where(least[:, :1] == _NONE, 0, least & _u(0xFFFFFFFF)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of the samples that are the same, by row: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points, rounded down, replaced by as many of the next text's first ones, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _first_keys(docs: DataFrame, parts: int) -> list[tuple]:
    """The first (id is not null, id, tie) of each of so many ranges of docs (_id, _tie), or fewer, ascending: one key a range."""
    key = F.struct(F.col("_id").isNotNull().alias("there"), F.col("_id").alias("id"), F.col("_tie").alias("tie"))
    ranged = docs.select(key.alias("_key")).repartitionByRange(parts, "_key")
    rows = ranged.groupBy(F.spark_partition_id().alias("_part")).agg(F.min("_key").alias("_key")).collect()
    return sorted((r._key.there, r._key.id or 0, r._key.tie) for r in rows)


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next id; after the last comes the first.
    Ids are cut into ranges, whose first keys alone (one a range) are known to
    the driver; each row is sent to its range, and a range's first row to the
    range before as well, where it ends the last pair. So texts are sent once,
    and a task reads its rows in order with one text held over.

    Null text: empty. A text without words has a fingerprint of zeros, like
    another one's. Order of equal ids: by a hash of the text; null ids come
    first. Repeated rows follow each other, and have equal rows but where the
    next differs. One document: it follows itself. Very long texts: memory of some
    200 bytes a byte. Clashing names: other columns aren't read. Empty table: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_tie"), text.alias("_text"))
    keys = _first_keys(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))

    @F.arrow_udf("array<int>")
    def ranges(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, ties in batches:
            out = []
            for i, tie in zip(ids.to_pylist(), ties.to_pylist(), strict=True):
                key = (i is not None, i or 0, tie)
                at = bisect_right(keys, key) - 1
                # a guest's range is written as -1 less it
                out.append([at, -1 - (at - 1) % len(keys)] if keys[at] == key else [at])
            yield pa.array(out, pa.list_(pa.int32()))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str] | None = None  # the last row, whose next one isn't there yet
        for batch in batches:
            guests = np.flatnonzero(batch.column(0).to_numpy())
            batch = batch.slice(0, int(guests[0]) + 1) if len(guests) else batch
            for group in in_groups(batch.column(2), GROUP):
                ids, texts = batch.column(1)[group].to_pylist(), batch.column(2)[group].to_pylist()
                if held is not None:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = ids[-1], texts[-1]
                if len(texts) > 1:
                    yield _told(ids, texts)
            if len(guests):
                return

    dealt = rows.withColumn("_at", F.explode(ranges("_id", "_tie"))).select(
        F.when(F.col("_at") < 0, -1 - F.col("_at")).otherwise(F.col("_at")).alias("_range"), (F.col("_at") < 0).cast("int").alias("_guest"), "_id", "_tie", "_text",
    )
    dealt = dealt.repartitionById(max(1, len(keys)), "_range").sortWithinPartitions("_guest", F.asc_nulls_first("_id"), "_tie").select("_guest", "_id", "_text")
    out = dealt.mapInArrow(told, "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    kind = docs.schema[id_col].dataType
    return out.select(F.col("_id").cast(kind).alias(id_col), *out.columns[1:])


def _told(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """The rows of all but the last text, each with the next."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, other = fingerprints(pa.array(texts, pa.string()), pa.array([*changed, ""], pa.string()))
    digits = lambda f: [row.astype(">u4").tobytes().hex() for row in f[:-1]]
    columns = {
        "_id": pa.array(ids[:-1], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()), "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        "fingerprint": pa.array(digits(own)), "edited_fingerprint": pa.array(digits(other)),
        "near_edited": pa.array(likeness(own[:-1], other[:-1])), "near_next": pa.array(likeness(own[:-1], own[1:])),
    }
    return pa.RecordBatch.from_pydict(columns)


def op11_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint_edits() of all documents."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
