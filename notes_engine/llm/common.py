"""What the training-data operators share: column helpers, and tables that cut lineage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.streaming.runs import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: 64-bit words of the table by which rows are sieved before they are sent anywhere: the bound of what is broadcast for it.
MOST_SIEVE_WORDS = 1 << 19
#: Partitions that gathered() leaves at least.
FEWEST_GATHERED = 40


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    On pure ASCII, lower() does just that, and faster than translate().
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even where body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column, gap: str = SPACE) -> Column:
    """The non-empty pieces between matches of gap."""
    return F.array_remove(F.split(text, gap), "")


def running_sum(values: Column, block: int = 1024) -> Column:
    """[0, v0, v0 + v1, ...] of an array of ints.

    Sums grow by appending; blocks keep the copying at n * n / block.
    """
    zero = F.array(F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda k: F.slice(values, k * block + 1, block))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    inner = lambda b, start: F.aggregate(b, F.array(start), grow)
    return F.when(F.size(values) == 0, zero).otherwise(F.aggregate(blocks, zero, lambda acc, b: F.concat(F.slice(acc, 1, F.size(acc) - 1), inner(b, F.element_at(acc, -1)))))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back; a lost executor costs no recomputation of what is before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for dropped()
    return out


def gathered(df: DataFrame) -> DataFrame:
    """df in no more than a fifth of the shuffle partitions or FEWEST_GATHERED, without a shuffle; for stored() tables that are smaller than the input.

    Small files cost more than their rows: where Hadoop's native library is
    missing, an executor starts a process for each, which shares its memory for
    a moment.
    """
    return df.coalesce(max(FEWEST_GATHERED, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 5))


@contextmanager
def batches_of(spark: SparkSession, size: str = "2m") -> Iterator[None]:
    """What runs inside passes at most about so many bytes at once between Spark and Python, however long its rows are; the session is as before after that."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def let_go() -> None:
    """Gives back what this Python worker has freed but still holds. A task does so at its end, as workers live longer than stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if trim is not None:
        trim(0)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes stored() tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def marked(rows: DataFrame, row_hash: Column, keys: DataFrame, key_hash: Column, name: str = "_may") -> DataFrame:
    """rows, with whether they may be among keys (a stored table), by 64-bit hashes, without a shuffle of rows.

    Keys' hashes set bits in a table of words, at most MOST_SIEVE_WORDS, that is
    broadcast. A row that isn't marked is not among keys; of those that are,
    some are marked in error, the more keys, the more, up to all.
    """
    words = min(MOST_SIEVE_WORDS, 1 << max(0, keys.count() - 1).bit_length())
    place = lambda h: (F.pmod(h, F.lit(words)).cast("int"), F.shiftrightunsigned(h, 58).cast("int"))
    word, bit = place(key_hash)
    table = keys.select(word.alias("_word"), F.expr("1L").alias("_one"), bit.alias("_bit")).select("_word", F.expr("shiftleft(_one, _bit)").alias("_set"))
    table = table.groupBy("_word").agg(F.bit_or("_set").alias("_bits"))
    word, bit = place(row_hash)
    found = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(table), "_word", "left")
    return found.withColumn(name, F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1L") != 0, F.lit(False))).drop("_word", "_bit", "_bits")


def sieved(rows: DataFrame, row_hash: Column, keys: DataFrame, key_hash: Column) -> DataFrame:
    """The rows that marked() marks; those marked in error are for a join or a group to take out."""
    return marked(rows, row_hash, keys, key_hash).where("_may").drop("_may")
