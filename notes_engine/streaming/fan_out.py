"""A stream of requests into one table a tool and one of dead letters, each request in one of them once, over any restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notes_engine.operators.commits import Commits
from notes_engine.sources import requests

DEAD = "dead"


class RoutedTables:
    """The tables under a folder that all executors reach.

    A micro-batch writes a folder of its number in each table and then commits
    that number. A batch that is run again, because a run ended before Spark
    noted it, overwrites its own folders, or does nothing if it was committed; so
    readers see every batch whole and once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    def write(self, batch: DataFrame, number: int) -> None:
        """Routes the rows (request_id, tool, arguments) of one micro-batch."""
        if self.commits.latest() > number:
            return
        judged = requests.reasons(batch).persist()  # each table reads it
        try:
            served, dead = requests.by_tool(judged)
            for name, rows in {**served, DEAD: dead}.items():
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
            self.commits.publish(number + 1, str(number))
        finally:
            judged.unpersist()

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Runs a stream of requests into the tables; its progress is kept beside them. trigger: as for writeStream.trigger()."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.path}/progress").trigger(**trigger).start()

    def table(self, name: str) -> DataFrame:
        """The committed rows of a tool, or DEAD, with the number of their micro-batch."""
        committed = self.commits.table(self.commits.latest()).select((F.col("number") - 1).alias("batch"))
        empty = self.spark.createDataFrame([], "request_id BIGINT, tool STRING, arguments STRING")
        served, dead = requests.route(empty)
        schema = (dead if name == DEAD else served[name]).schema.add("batch", "long")
        if not self.commits.latest():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").join(committed, "batch", "left_semi")
