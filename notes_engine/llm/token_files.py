"""Token-id files: documents' ids in ascending order of their ids, in patched frame-of-reference segments, and their reading."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notes_engine.llm import pfor
from notes_engine.llm.tokens import DEFAULT_VOCABULARY, encoder, forget_pieces, in_groups
from notes_engine.streaming.runs import shared_dir

#: A segment is closed after the group of documents with which it reaches so many ids.
SEGMENT_IDS = 1 << 20


def write_token_files(
    docs: DataFrame, path: str, *, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encodes every text, appends end_id, and writes segments in ascending order of (id, hash of the text) to path.

    Rows are range-partitioned by that order, so that files, and segments in
    them, follow each other; repeated or null ids (these come first) don't pile
    up in one task. A record of a file is a segment: part and segment (its
    place), ids (their number), the documents' ids and lengths, and the payload,
    a pfor segment. Files are written by Spark's committer: a task that is lost
    or run twice leaves one copy. Memory follows SEGMENT_IDS or the longest
    document. Null and empty text: end_id alone. Empty table: no records.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part long, segment long, n_ids long, doc_ids array<{kind}>, lengths array<long>, payload binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        part, segment, size = TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal names, held, sizes, size, segment
            ids, keys = np.concatenate(held), pa.concat_arrays(names)
            lengths = pa.array(np.concatenate(sizes), pa.int64())
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            cols = [pa.array([part], pa.int64()), pa.array([segment], pa.int64()), pa.array([len(ids)], pa.int64()), one(keys), one(lengths), pa.array([pfor.encode(ids)], pa.binary())]
            names, held, sizes, size, segment = [], [], [], 0, segment + 1
            return pa.RecordBatch.from_arrays(cols, names=["part", "segment", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for group in in_groups(batch.column(1)):
                keys, texts = (batch.column(c)[group] for c in range(2))
                ids, lengths = enc.encode_all(texts, end_id)
                names.append(keys)
                held.append(ids)
                sizes.append(lengths)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()
        forget_pieces()

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    ordered = rows.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text")
    ordered.mapInArrow(encoded, schema).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document: id, start (ids of all documents before it), n_tokens, ids_crc32, and ids (unless with_ids is false).

    Segments are decoded where they are read. Where each starts comes from their
    sizes alone: summed by part (as many rows as files), then inside each part.
    """
    records = spark.read.parquet(path)
    kind = records.schema["doc_ids"].dataType.elementType.simpleString()
    out = f"part long, segment long, {id_col} {kind}, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, segment, names, lengths, payload = (batch.column(c)[k] for c in range(5))
                ids = np.ascontiguousarray(pfor.decode(payload.as_buffer().to_pybytes()), "<u4")
                sizes = lengths.values.to_numpy()
                ends = np.cumsum(sizes)
                raw = memoryview(ids).cast("B")
                cols = [
                    pa.array(np.full(len(sizes), part.as_py())), pa.array(np.full(len(sizes), segment.as_py())), names.values,
                    pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(ends - sizes, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "segment", id_col, "inner", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    sizes = records.select("part", "segment", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("_part_at"))
    segments = sizes.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("_segment_at"))
    places = segments.join(parts, "part").select("part", "segment", (F.col("_part_at") + F.col("_segment_at")).alias("_at"))
    docs = records.select("part", "segment", "doc_ids", "lengths", "payload").mapInArrow(decoded, out)
    return docs.join(places, ["part", "segment"]).select(id_col, (F.col("_at") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """write_token_files() of all documents to the shared folder, then read_token_files()."""
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path, with_ids=False)
