"""Vector code compression: product codebooks by integer rounds, nearest entries by Orchard's search.

For each entry, all entries are listed by their distance from it. A search starts
at an entry and goes through its list; an entry nearer to the point than the best
so far becomes the best and its list is gone through from the start, without
entries that were visited. It ends where the list goes beyond twice the best
distance: an entry j nearer than the best b would have
d(b, j) <= d(b, x) + d(x, j) <= 2 d(b, x). So the result is exact, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this have squared distances that a long may not hold.
LARGEST = float(1 << 20)
#: Leading components of a part by which its search chooses where to start.
START_BITS = 6
#: Parts of vectors that are searched together.
AT_ONCE = 1 << 15


class Orchard:
    """Nearest entries of one part's codebook, ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(-1)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.bits = min(entries.shape[1], START_BITS)
        self.middle = entries[:, : self.bits].mean(axis=0)
        cells = self._cells(entries)
        self.starts = np.full(1 << self.bits, self._central(np.arange(len(entries))))
        for c in np.unique(cells):
            self.starts[c] = self._central(np.flatnonzero(cells == c))

    def _cells(self, points: np.ndarray) -> np.ndarray:
        return ((points[:, : self.bits] > self.middle) << np.arange(self.bits)).sum(axis=1)

    def _central(self, some: np.ndarray) -> int:
        here = self.entries[some]
        return int(some[((here - here.mean(axis=0)) ** 2).sum(axis=1).argmin()])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each point. All points take their next step together."""
        k = len(self.entries)
        best = self.starts[self._cells(points)]
        error = ((points - self.entries[best]) ** 2).sum(axis=1)
        visited = np.zeros((len(points), k), bool)
        active = np.arange(len(points))
        visited[active, best] = True
        place = np.zeros(len(points), np.int64)
        while len(active):
            b, p = best[active], place[active]
            inside = self.apart[b, p] <= 4 * error[active]  # not beyond twice the distance
            active, j = active[inside], self.order[b[inside], p[inside]]
            place[active] += 1
            new = ~visited[active, j]
            at, j = active[new], j[new]
            visited[at, j] = True
            d = ((points[at] - self.entries[j]) ** 2).sum(axis=1)
            better = (d < error[at]) | ((d == error[at]) & (j < best[at]))
            at, j = at[better], j[better]
            best[at], error[at], place[at] = j, d[better], 0
            active = active[place[active] < k]
        return best, error


def kept_vectors(vectors: DataFrame, *, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector isn't null and has finite components alone, none beyond LARGEST."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return vectors.where(F.col(vector_col).isNotNull() & F.coalesce(good, F.lit(False)))


def _whole(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as integers, (vector, part, place): each component times SCALE, rounded down; zeros beyond a vector's end."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    out = np.zeros((len(lists), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < sizes[:, None]] = flat
    return out.reshape(len(lists), PARTS, width)


def _searched(books: np.ndarray, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group of vectors: (vectors as integers, indexes of their nearest entries, squared distances), by vector and part."""
    searches = [Orchard(entries) for entries in books]
    for at in range(0, len(lists), AT_ONCE):
        v = _whole(lists[at : at + AT_ONCE], books.shape[2])
        found = [s.nearest(v[:, p]) for p, s in enumerate(searches)]
        yield v, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def first_codebooks(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, place): the parts of the vectors with the smallest ids, ties by the vectors; as many entries as there are vectors, up to `entries`."""
    width = -(-(vectors.agg(F.max(F.size(vector_col))).first()[0] or 0) // PARTS) or 1
    rows = vectors.orderBy(F.asc_nulls_last(id_col), F.asc(vector_col)).select(F.col(vector_col).cast("array<double>").alias("v")).limit(entries).collect()
    return _whole(pa.array([r.v for r in rows], pa.list_(pa.float64())), width).transpose(1, 0, 2)


def next_codebooks(vectors: DataFrame, books: np.ndarray, *, vector_col: str = "embedding") -> np.ndarray:
    """One round: each entry becomes the mean, rounded down, of the parts that are nearest to it; one without parts stays.

    A task adds up its vectors in one array of the codebooks' size and sends a
    row a component, so neither a common vector nor the number of vectors
    matters for what is shuffled; the driver gets one row a component.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for v, index, _ in _searched(books, batch.column(0)):
                for p in range(PARTS):
                    np.add.at(total[p], index[:, p], v[:, p])
                    n[p] += np.bincount(index[:, p], minlength=books.shape[1])
        used = np.flatnonzero(np.repeat(n.ravel(), books.shape[2]))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.repeat(n.ravel(), books.shape[2])[used]), pa.array(total.ravel()[used])], names=["at", "n", "total"])

    sums = vectors.select(vector_col).mapInArrow(summed, "at long, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = books.copy().ravel()
    for at, n, total in sums.collect():
        out[at] = int(Decimal(total)) // n
    return out.reshape(books.shape)


def fit_codebooks(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) after so many rounds over all vectors, as kept_vectors() leaves them."""
    books = first_codebooks(vectors, id_col=id_col, vector_col=vector_col, entries=entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = next_codebooks(vectors, books, vector_col=vector_col)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and place, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray, *, vector_col: str = "embedding") -> DataFrame:
    """vectors with code (two hex digits a part) and error (squared distances to the entries, summed). Columns with those names are replaced. One pass, no shuffle."""

    @F.arrow_udf("struct<code:string,error:long>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            codes, errors = [], [np.zeros(0, np.int64)]
            for _, index, error in _searched(books, lists):
                digits = index.astype(np.uint8).tobytes().hex()
                codes += [digits[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(index))]
                errors.append(error.sum(axis=1))
            yield pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], ["code", "error"])

    new = vectors.withColumn("_told", told(F.col(vector_col)))
    return new.withColumns({"code": F.col("_told.code"), "error": F.col("_told.error")}).drop("_told")


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), one row per kept row: label_error is the error summed over rows of the same label, nulls together.

    entries: 256 at most. Rows whose vector is null, or has a null, non-finite or
    larger component than LARGEST, are left out. Shorter vectors, and lengths
    that PARTS doesn't divide, count as with zeros at the end. Null ids come
    last. Ties: the lower index; of equal ids, the smaller vector first. Repeated
    rows: each has its row and weighs in the rounds. Fewer vectors than entries:
    as many entries. Very long vectors: memory of a batch of them. Clashing
    names: other columns aren't read. Empty table: no rows.

    Results are written once; a label's sum is gathered in each task first, and a
    hot label's rows are a skewed join, which adaptive execution splits.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    own = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.col(label_col).alias("_label"))
    rows = kept_vectors(own, vector_col="_v")
    books = fit_codebooks(rows, id_col="_id", vector_col="_v", entries=entries, rounds=rounds)
    codes = stored(encoded(rows, books, vector_col="_v").select("_id", "_label", "code", "error"), "codes")
    labels = codes.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error"))
    out = codes.join(labels, F.col("_label").eqNullSafe(F.col("_l")))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compress() of all embeddings."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql() -> str:
    apart = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""a{k} AS (
  SELECT vec_id, label, p, any_value(x) AS x, CAST(min(d * 256 + e) % 256 AS INT) AS e, CAST(min(d) AS BIGINT) AS d
  FROM (SELECT vec_id, label, parts.p, x, e, CAST({apart} AS BIGINT) AS d FROM parts JOIN c{k} ON parts.p = c{k}.p) GROUP BY vec_id, label, p)""")
        if k < ROUNDS:
            out.append(f"""m{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM parts)) t(i) GROUP BY p, e, i) GROUP BY p, e),
c{k + 1} AS (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    return ",\n".join(out)


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(p)
), c0 AS (
  SELECT p, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}) USING (vec_id)
), {_rounds_sql()}, books AS (
  SELECT sha256(array_to_string(list(y ORDER BY p, e, i), ',')) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM c{ROUNDS})
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""
