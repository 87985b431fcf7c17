"""Running a stream to its end into a table in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.streaming.processors import PROVIDER


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A new temporary one where that is unset and all runs on one machine; else ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        found = f"file://{tempfile.mkdtemp(prefix='spark-notes-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: State is kept in RocksDB; a micro-batch writes what changed in it, not all of it, to the shared folder.
STATE = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: Micro-batches that arrivals() makes of a table.
ARRIVALS = 6


def arrivals(df: DataFrame, at: Column, late: Column, name: str) -> DataFrame:
    """A stream of df in ARRIVALS micro-batches or somewhat more, by the number at (least to greatest in equal steps), and a step later where late is true.

    The rows are written to the shared folder a step at a time, as a file source
    reads files in the order of their times.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    low, high = df.agg(F.min(at), F.max(at)).first()
    low, high = low or 0, high or 0
    step = F.floor((at - low) * (ARRIVALS - 1) / (high - low + 1)) + late.cast("int")
    rows = df.withColumn("_step", F.coalesce(step, F.lit(0)))
    for k in range(ARRIVALS):
        rows.where(F.col("_step") == k).drop("_step").write.parquet(f"{path}/step={k}")
    files = len(spark.read.parquet(f"{path}/step=*").inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // ARRIVALS)).parquet(f"{path}/step=*")


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All that the stream emits until its input is read, with batch_id. State is in RocksDB, checkpoints and rows in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/part={batch_id}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    try:
        for key, value in STATE.items():
            spark.conf.set(key, value)
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    full = schema.add("batch_id", "long")
    if query.lastProgress is None:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{path}/rows/part=*")
