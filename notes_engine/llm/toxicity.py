"""Toxicity: a character n-gram classifier with naive Bayes scaled features, trained on the labels table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.ngram_model import NgramModel, fit_ngram_model, sample_by_class

#: Labelled documents of each class that the model is fitted on at most.
SAMPLE_PER_CLASS = 2048
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE_PER_CLASS) -> NgramModel:
    """Fits on at most `most` labelled documents of each class, held-out ones left out.

    Null labels and ids are not learned from; of several labels of an id the
    largest counts. The ids of the sample are the side that is broadcast.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("label"))
    ids = sample_by_class(known, id_col=id_col, label_col="label", classes=2, most=most)
    sample = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(ids), id_col)
    return fit_ngram_model(sample.select("text", "label", "weight"), 2)


def score_toxicity(docs: DataFrame, model: NgramModel, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 if score >= threshold).

    Only the text is scored, the whole of it. No shuffle. Null text: as empty.
    Null ids and repeated rows pass through; equal texts have equal scores. Very
    long texts: memory of 30 bytes a character. Further columns of docs are not
    read, whatever their names. Empty table: no rows.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.probabilities(texts.to_pylist())[:, 1])

    return docs.select(F.col(id_col), scored(F.coalesce(F.col(text_col), F.lit(""))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of the labels that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
