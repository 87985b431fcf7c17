"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep one stable id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.common import UPPER, ascii_lower, marked, sieved, stored


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, text_md5.

    Texts are equal when their bytes are, after lower-casing A-Z. Rows are
    grouped by MD5 first, as digests without text; a hash that stands alone
    needs no more. Texts of the others, found by a sieve of bounded size, are
    grouped by (MD5, text): bytes decide, so two texts with one hash stay apart.
    The count and the id that stays (keep: "min" or "max" of a group) are
    gathered before that shuffle; a hot group sends one row from each task. Rows
    then find their group by two digests; a hot group's rows there are a skewed
    join, which adaptive execution splits.

    Null text: empty text. Null ids: they join groups, but stay only where a
    group has no other id. Repeated rows with one id: each gets the same row, so
    all or none are kept (drop repeats by id after that). Empty table: no rows.
    Very long texts: memory in proportion to their bytes; one that stands alone
    isn't sent. Other columns of docs are not read.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    sha = F.unhex(F.sha2("_norm", 256)).alias("_sha")
    digests = stored(rows.select("_id", _md5("_norm").alias("_md5"), sha), "digests")
    shared = stored(_shared(digests), "shared")
    texts = rows.select("_id", "_norm", _md5("_norm").alias("_md5"))
    pick = {"min": F.min, "max": F.max}[keep]
    groups = (
        sieved(texts, F.xxhash64("_md5"), shared, F.xxhash64("_md5")).groupBy("_md5", "_norm").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1").select("_md5", sha, "_keep", "_size")
    )
    keep_id = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return (
        digests.join(groups, ["_md5", "_sha"], "left")
        .select(
            F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"), F.col("_id").eqNullSafe(keep_id).alias("kept"),
            F.lower(F.hex("_sha")).alias("text_sha256"), F.lower(F.hex("_md5")).alias("text_md5"),
        )
    )


def _md5(norm: str) -> Column:
    return F.unhex(F.md5(F.col(norm).cast("binary")))


def _shared(digests: DataFrame) -> DataFrame:
    """The hashes that more than one row has."""
    return digests.groupBy("_md5").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_md5")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with the columns of docs; one row of repeated ones.

    A row whose hash stands alone passes through and isn't sent. Of the others,
    the group's row is chosen in the aggregate itself, before the shuffle, so a
    hot group sends one row from each task. Null text: empty text. Null ids lose
    against any other. Empty table: no rows.
    """
    better = {"min": F.min_by, "max": F.max_by}[keep]
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # A null id loses against any other: ids are wrapped, so that none is ignored.
    rank = F.struct(F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull(), F.col(id_col))
    keyed = docs.select(row.alias("_row"), rank.alias("_rank"), norm.alias("_norm")).withColumn("_md5", _md5("_norm"))
    shared = stored(_shared(keyed.select("_md5")), "shared")
    found = marked(keyed, F.xxhash64("_md5"), shared, F.xxhash64("_md5"))
    grouped = found.where("_may").groupBy("_md5", "_norm").agg(better("_row", "_rank").alias("_row"))
    return found.where("NOT _may").select("_row.*").union(grouped.select("_row.*"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup() over all documents, keeping the largest doc_id of equal texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
