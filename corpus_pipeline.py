"""Corpus preparation in five stages: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Null texts count as empty;
empty tables give empty tables; further columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm import mixing, quality_rules
from notes_engine.llm.common import batches_of, marked, stored
from notes_engine.llm.exact_dedup import keep_one
from notes_engine.llm.ngram_join import ngram_join
from notes_engine.llm.packing import pack
from notes_engine.streaming.runs import shared_dir

#: In the last stages, what passes to Python at once, and the bytes of pieces that a worker remembers in packing: executors hold much by then.
BATCH = "950k"
REMEMBERED = 60_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the full policy. The ledger is made on the rows themselves, so nothing is joined."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_t"))
    led = quality_rules.ledger(row, id_col="_row", text_col="_t")
    return led.where(quality_rules.passes(quality_rules.FULL)).select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the smallest id."""
    return keep_one(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets hold together, that with the smallest id; documents without words stay.

    Exact dedup leaves one row of equal texts, not of equal ids, so rows are
    told apart by id and text. Of equal ids one is kept by its text's hash; rows
    without an id come after all others.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_i"), F.col("text").alias("_t"))
    row = row.withColumn("_h", F.xxhash64(F.coalesce("_t", F.lit(""))))
    found = ngram_join(row.withColumn("_key", F.struct(F.col("_i").isNull().alias("none"), F.col("_i").alias("id"), F.col("_h").alias("tie"))), id_col="_key", text_col="_t")
    dropped = stored(found.where(F.col("_key") != F.col("component_id")).select(F.col("_key.id").alias("_di"), F.col("_key.tie").alias("_dh")).distinct(), "dropped")
    told = marked(row, F.xxhash64("_i", "_h"), dropped, F.xxhash64("_di", "_dh"))  # the rows that stay for certain aren't sent
    kept = told.where("_may").join(dropped, F.col("_i").eqNullSafe(F.col("_di")) & (F.col("_h") == F.col("_dh")), "left_anti")
    return told.where("NOT _may").select("_row.*").union(kept.select("_row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the domains of the labels table to their target weights.

    Targets take the clean domain whole, so its documents' rates are near 1 and
    stay; others are thinned. No document is repeated: rates are fitted under
    the bound of 1, so that what is kept is what was fitted.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_i"), F.col("text").alias("_t"))
    with batches_of(spark, BATCH):
        model = mixing.fit_domains(row, mixing.label_domains(labels).withColumnRenamed("doc_id", "_i"), tuple(mixing.DOMAIN_WEIGHTS), id_col="_i", text_col="_t")
        scored = stored(mixing.with_posteriors(row, model, id_col="_i", text_col="_t").select("_row", "n_tokens", "posterior", "chance"), "scored")
    return mixing.apply_mix(scored, mixing.fit_mix(scored, mixing.DOMAIN_WEIGHTS, highest=1.0)).where(F.col("copies") >= 1).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens at most, with their ids."""
    with batches_of(spark, BATCH):
        return stored(pack(docs, remembered=REMEMBERED), "packed")  # written here, as batches are those of the time of writing


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", packing)]

#: The fitted classifier and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
