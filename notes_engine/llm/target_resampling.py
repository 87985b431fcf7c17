"""Target-distribution importance resampling: scores from an array of n-gram gains, and a draw of the highest by bisection over exact counts.

1. Runs of 1 to ORDER words are hashed into buckets and counted, in the corpus and
   in the target; each task sends one row a bucket. A bucket's gain tells how much
   commoner it is in the target.
2. Each document is scored by an array of the gains (BUCKETS numbers) and a
   random number that depends on its id alone; scores are written once.
3. The cut-off of the draw, a score and, among equal ones, an id, is bisected:
   each job counts how many rows lie at or before CUTS values at once. Nothing
   is sorted for it and no row goes to the driver.
4. Drawn rows are range-partitioned by their order, so a rank is the size of the
   ranges before, and the place in its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notes_engine.llm.byte_words import LETTERS, Words, crc32_after
from notes_engine.llm.common import UPPER, stored
from notes_engine.llm.tokens import in_groups

ORDER, BUCKETS, SEED = 3, 10_000, 42
#: Documents with fewer words aren't drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 5
#: Values that one job counts at: a round narrows the cut-off to a part in CUTS + 1.
CUTS = 15
_SPACE_CRC = np.uint32(0xE96CCF45)
_LAST_ID = (1 << 63) - 1


def _buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group of texts: (each feature's bucket, each feature's text in the group, each text's number of words)."""
    for group in in_groups(texts):
        words = Words(texts[group], LETTERS)
        own, sizes = words.crc32(), words.size
        n = np.diff(words.bounds)
        text = np.repeat(np.arange(len(n)), n)
        runs, found, of = own, [own], [text]
        for k in range(1, ORDER):
            led = crc32_after(runs[:-1], np.ones(len(runs[:-1]), np.int64)) ^ _SPACE_CRC  # each run, and a space
            runs = crc32_after(led, sizes[k:]) ^ own[k:]
            here = text[k:] == text[: len(text[k:])]
            found.append(runs[here])
            of.append(text[k:][here])
        yield np.concatenate(found) % np.uint32(BUCKETS), np.concatenate(of), n


def count_features(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket. A task counts in one array and sends its buckets, so what is shuffled doesn't follow the texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for bucket, _, _ in _buckets(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: floor(1000 ln) of its part of the target over its part of the corpus, both with one feature more in each bucket."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: ((t + 1.0) * (s_all + BUCKETS)) / ((s + 1.0) * (t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g from the Gumbel distribution by a hash of seed and id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def score_documents(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score), one row per row of docs: weight is the sum of its features' gains, score is weight and noise.

    One pass, no shuffle. Null text: no features, weight 0. Null ids: the noise
    of an empty id. Repeated rows: alike. Very long texts: memory of some 100
    bytes a word. Other columns of docs aren't read. Empty table: no rows.
    """

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            for bucket, text, n in _buckets(texts):
                columns[0].append(n)
                columns[1].append(np.bincount(text, minlength=len(n)))
                whole = np.zeros(len(n), np.int64)
                np.add.at(whole, text, gain[bucket])
                columns[2].append(whole)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in columns], ["n_words", "n_features", "weight"])

    told = docs.select(F.col(id_col).alias(id_col), weighed(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    rows = told.select(id_col, "_w.n_words", "_w.n_features", "_w.weight")
    return rows.withColumn("score", F.col("weight") + noise(F.col(id_col), seed))


def least_value(rows: DataFrame, column: Column, need: int, low: int, high: int) -> tuple[int, int]:
    """(v, below): the least integer v with need rows or more at column <= v, and how many rows have less. All values are in low to high, need is 1 or more."""
    below = 0
    while low < high:
        cuts = sorted({low + (high - low) * k // (CUTS + 1) for k in range(1, CUTS + 1)} | {low})
        cuts = [c for c in cuts if c < high]
        counts = rows.agg(*[F.count(F.when(column <= c, 1)).alias(f"c{k}") for k, c in enumerate(cuts)]).first()
        for c, n in zip(cuts, counts, strict=True):
            if n >= need:
                high = c
                break
            low, below = c + 1, n
    return low, below


def drawn(scored: DataFrame, k: int, *, id_col: str = "doc_id", score_col: str = "score", row_col: str = "row") -> Column:
    """The condition for the k rows of scored with the highest scores, ties to the smaller id; of rows with one id and score, the smaller row number.

    scored: a written table with row, a number of its own for each row; k is at most its rows.
    """
    last = F.coalesce(F.col(id_col), F.lit(_LAST_ID))
    levels = [-F.col(score_col), last, F.col(row_col)]
    taken, level = F.lit(False), F.lit(True)
    if k < 1:
        return taken
    for at in levels:
        rows = scored.where(level)
        low, high = rows.agg(F.min(at), F.max(at)).first()
        v, below = least_value(rows, at, k, low, high)
        taken, k = taken | (level & (at < v)), k - below
        level = level & (at == v)
        if scored.where(level).count() == k:
            break
    return taken | level


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 1. Ranges of it are dealt out and sorted in tasks; a row a range tells how many rows are before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, "ranges")
    part = F.shiftright("_at", 33).alias("_part")
    parts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(parts, "_part").withColumn(name, F.col("_before") + within + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank), one row per row of docs; rank is null where the row isn't drawn.

    Of the rows with least_words words or more, percent in a hundred are drawn,
    rounded down: those with the highest scores, so as if without replacement in
    proportion to exp(weight / 1000). Ids are integers. Null texts: no words. Null
    ids: after all others of a score. Repeated rows: each may be drawn. An empty
    target or corpus: all counts 0. Empty docs: no rows. Clashing names: other columns
    of docs aren't read.
    """
    gain = gains(count_features(docs, text_col=text_col), count_features(target, text_col=target_text_col))
    scored = score_documents(docs, gain, id_col=id_col, text_col=text_col, seed=seed).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "scores")
    enough = F.col("n_words") >= least_words
    eligible = scored.where(enough)
    chosen = enough & drawn(eligible, percent * eligible.count() // 100, id_col=id_col)
    top = ranked(scored.where(chosen), [F.desc("score"), F.asc_nulls_last(id_col), F.asc("row")])
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    columns = [id_col, "n_features", "weight", "score", "rank"]
    return rest.select(columns).unionByName(top.select(columns))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resample() of all documents towards the texts of benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)


def _words_sql(table: str, name: str) -> str:
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"SELECT {name}, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{gap}'), lambda x: x <> '') AS w FROM {table}"


_RUNS_SQL = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
#: CRC-32 goes bit by bit: a byte enters with the first of its eight steps.
ORACLE_SQL = f"""
WITH d AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}),
df AS (SELECT doc_id, unnest({_RUNS_SQL}) AS f FROM d), bf AS (SELECT unnest({_RUNS_SQL}) AS f FROM b),
crc AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: [CAST('0x' || h AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % {BUCKETS} AS k FROM (SELECT f FROM df UNION SELECT f FROM bf)
), s AS (SELECT k, count(*) AS n FROM df JOIN crc USING (f) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bf JOIN crc USING (f) GROUP BY k),
gain AS (
  SELECT k, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM df) + {BUCKETS})) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bf) + {BUCKETS})))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (k)
), weight AS (SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM df JOIN crc USING (f) JOIN gain USING (k) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n >= {LEAST_WORDS}) OVER () AS can FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= {LEAST_WORDS} AND place <= {PERCENT} * can // 100 THEN place END AS rank FROM placed
"""
