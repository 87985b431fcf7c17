"""Quality rules: a bitmask ledger. Every rule is evaluated once a document; policies and ablations read only the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.common import SPACE, let, words_of

#: Words in a window whose repetition counts.
WINDOW = 5

#: Measurements of one text, by name, in the order of the ledger.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")

#: Rules by bit: name, and the condition that fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "n_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_shouts > 30 * n_words"),
    ("word_length", "10 * word_chars < 20 * n_words OR word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules that reject. Rules may be added to RULES at the end; old policies keep their meaning."""

    version: str
    rules: tuple[str, ...] = field(default=())

    @property
    def mask(self) -> int:
        return reduce(lambda a, b: a | b, (BIT[r] for r in self.rules), 0)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(name for name, _ in RULES))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text, the first place included.

    Most texts repeat none: as many distinct window hashes as windows says so
    for sure. Only for the others are the windows' strings sorted, equal
    neighbours marked, and the marked places, in order, summed up.
    """

    def hashes(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])), 1, F.size(w) - (WINDOW - 1))

    def covered(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("k"), i.alias("i"))))
        same = lambda a, j, x: F.coalesce(F.get(a, j)["k"] == x["k"], F.lit(False))
        twice = let(windows, lambda a: F.filter(a, lambda x, j: same(a, j - 1, x) | same(a, j + 1, x)))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, 0).when(F.size(F.array_distinct(hashes(w))) == F.size(w) - (WINDOW - 1), 0).otherwise(covered(w)))


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the MEASURES (long), fail_bits (long; bit i set: RULES[i] fails), and keep_cols.

    One pass over the text, no shuffle. Null text: as empty, which fails
    few_words. Null ids and repeated rows pass through. Very long texts take
    memory in proportion to their words. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit("!!")).cast("long").alias("n_shouts"),
        )

    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(RULES)])
    out = docs.select(F.col(id_col), *[F.col(f"`{c}`") for c in keep_cols], let(words_of(text, SPACE), measured).alias("_m"))
    return out.select(id_col, *[f"`{c}`" for c in keep_cols], "_m.*").withColumn("fail_bits", bits)


def passes(policy: Policy, bits: Column | None = None) -> Column:
    """True where no rule of the policy failed."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does: policy, rule, n_failed, n_only (rejected by this rule alone), n_kept_without, n_docs.

    The documents are first counted by fail_bits (at most 2^rules rows), then
    the bits of those counts are tested. Empty ledger: zero counts.
    """
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    one_row = counts.agg(
        total(F.lit(True)).alias("n_docs"),
        *[c for r in policy.rules for c in (
            total(F.col("bits").bitwiseAND(F.lit(BIT[r])) != 0).alias(f"failed_{r}"),
            total(F.col("bits") == BIT[r]).alias(f"only_{r}"),
            total(F.col("bits").bitwiseAND(F.lit(policy.mask & ~BIT[r])) == 0).alias(f"without_{r}"),
        )],
    )
    rows = F.array(*[F.struct(F.lit(policy.version).alias("policy"), F.lit(r).alias("rule"), F.col(f"failed_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only"), F.col(f"without_{r}").alias("n_kept_without"), F.col("n_docs")) for r in policy.rules])
    return one_row.select(F.explode(rows).alias("r")).select("r.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the full policy."""
    led = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return led.select("doc_id", *MEASURES[:5], (~passes(BASE)).alias("base_failed"), passes(FULL).alias("kept"), "fail_bits")


_FAILS = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))
ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t
), windows AS (
  SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS k
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows WHERE k IS NOT NULL) WHERE c >= 2
), covered AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(regexp_extract_all(text, '!!')) AS n_shouts
  FROM t LEFT JOIN covered USING (doc_id)
), bits AS (SELECT *, CAST({_FAILS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {BASE.mask}) <> 0 AS base_failed, (fail_bits & {FULL.mask}) = 0 AS kept, fail_bits
FROM bits
"""
