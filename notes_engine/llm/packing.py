"""Packing token streams into sequences: order-preserving dynamic programming over cuts, with monotone-queue transitions."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notes_engine.llm.common import let_go
from notes_engine.llm.tokens import DEFAULT_VOCABULARY, encoder, forget_pieces, in_groups

#: What a cut costs, in tokens of padding: at a document's end, at a sentence's, and elsewhere; and what each sequence costs.
CUT_COST = {"document": 0.0, "sentence": 2.0, "elsewhere": 24.0}
SEQUENCE_COST = 1.0
#: Inside longer sentences, a cut is possible after each so many tokens.
STRIDE = 64
#: Sequences shorter than the limit that need no padding: powers of two from here on.
LEAST_POWER = 64
#: Tokens that are packed together; what is left at the end of a part is its own last sequence.
PART_TOKENS = 1 << 20


def best_cuts(places: list[int], costs: list[float], limit: int) -> list[int]:
    """Which of the places (ascending, from 0 to the end, no gap over limit) to cut at, for the least total cost.

    cost(k) = costs[k] + least over j of cost(j) + padding(places[k] - places[j]). Padding to the limit is
    limit - places[k] + places[j], so that the least cost(j) + places[j] of a sliding window decides: a
    monotone queue holds it. Lengths that are powers of two need no padding; each is one more transition.
    """
    n, kind = len(places), np.int32 if places[-1] < 1 << 31 else np.int64
    at = np.asarray(places, kind)
    where = np.full(at[-1] + 1, -1, kind)  # which place a token count is, if any
    where[at] = np.arange(n)
    powers = np.array([p for p in (1 << b for b in range(limit.bit_length())) if LEAST_POWER <= p <= limit], kind)
    origin = at[:, None] - powers
    origin = np.where(origin >= 0, where[np.maximum(origin, 0)], -1)
    found = origin >= 0
    bounds, exact = np.concatenate(([0], np.cumsum(found.sum(axis=1)))).tolist(), origin[found].tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for k in range(1, n):
        p = places[k]
        while queue[0][1] < p - limit:
            queue.popleft()
        head = queue[0]
        best, chosen = head[0] + (limit - p), head[2]
        for j in exact[bounds[k] : bounds[k + 1]]:
            if cost[j] <= best:
                best, chosen = cost[j], j
        best += costs[k] + SEQUENCE_COST
        cost[k], back[k] = best, chosen
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, k))
    cuts, k = [], n - 1
    while k:
        cuts.append(places[k])
        k = back[k]
    return cuts[::-1]


def cut_part(lengths: np.ndarray, ids: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """The ends of the sequences that a part (documents' ids, one after the other) is cut into."""
    document = np.cumsum(lengths)
    kind = np.zeros(len(ids) + 1, np.int8)  # 1: elsewhere, 2: a sentence's end, 3: a document's
    kind[1:][ends[ids]] = 2
    kind[document] = 3
    marks = np.concatenate(([0], np.flatnonzero(kind)))
    wide = np.flatnonzero(np.diff(marks) > STRIDE)
    for k in wide:
        kind[marks[k] + STRIDE : marks[k + 1] : STRIDE] = 1
    places = np.flatnonzero(kind)
    cost = np.array([0.0, CUT_COST["elsewhere"], CUT_COST["sentence"], CUT_COST["document"]])[kind[places]]
    return np.array(best_cuts([0, *places.tolist()], [0.0, *cost.tolist()], limit), np.int64)


def pack(
    docs: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY, limit: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (unless with_ids is false).

    Each row of docs is encoded, end_id is appended, and the ids of each input
    partition, in its order, are cut into sequences of limit at most. A part of
    about PART_TOKENS ids is cut at a time, so memory follows that, or the
    longest document. No shuffle, nothing on the driver; sequence_id is the
    partition's number and the sequence's in it, so a part that is computed
    anew gives the same ids for the same input. Padding is small, not nought:
    each part may end in one short sequence. remembered: bytes of pieces and their
    ids that a worker remembers (CACHE_BYTES if not given); it decides time and
    memory, not results. Null and empty text: end_id alone.
    Null ids pass through; repeated rows are packed each. Empty table: no rows.
    """
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    if with_ids:
        out = out.add("ids", T.ArrayType(T.IntegerType()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        enc.memory.most = remembered
        ends = enc.sentence_ends()
        ends[end_id] = False
        number = TaskContext.get().partitionId() << 33
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal names, held, sizes, size, number
            if not held:
                return
            ids = np.concatenate(held)
            lengths = np.concatenate(sizes)
            stops = cut_part(lengths, ids, ends, limit)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            begin = np.union1d(starts[:-1], np.concatenate(([0], stops[:-1])))
            end = np.append(begin[1:], len(ids))
            doc = np.searchsorted(starts, begin, side="right") - 1
            seq = np.searchsorted(stops, begin, side="right")
            seq_start = np.concatenate(([0], stops))[seq]
            raw = memoryview(ids).cast("B")
            cols = [
                pa.concat_arrays(names).take(pa.array(doc)), pa.array(begin - starts[doc]), pa.array(end - begin),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.int64()),
                pa.array(lengths[doc]), pa.array(number + seq), pa.array(begin - seq_start),
            ]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            number += len(stops)
            names, held, sizes, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

        for batch in batches:
            for part in in_groups(batch.column(1)):
                keys, texts = (batch.column(c)[part] for c in range(2))
                ids, lengths = enc.encode_all(texts, end_id)
                names.append(keys)
                held.append(ids)
                sizes.append(lengths)
                size += len(ids)
                if size >= PART_TOKENS:
                    yield from flush()
        yield from flush()
        forget_pieces()
        let_go()

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(packed, out)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() over all documents, with the ids of each piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
