"""Numbered commits: what makes written tables part of a store, one writer at a time per number.

A writer works on the version that it has read, writes its tables under a token
of its own, and then creates the file of the next number with that token in it.
Of several writers one gets the number; the others look at what was committed
meanwhile and try the next, or work again. Tables of tokens that no number holds
don't exist for readers, so a writer that dies leaves nothing half done.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commits:
    """The commits under a folder of a file system on which a file can be renamed to a name that must not exist, as HDFS does in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def latest(self) -> int:
        """The highest number; 0 without commits."""
        at = self._at()
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def publish(self, number: int, token: str) -> bool:
        """Makes token's tables part of version `number` and all later ones; False if another writer has the number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, at = self._at(f".{uuid.uuid4().hex}"), self._at(f"{number:020d}.json")
        fs = at.getFileSystem(conf)
        out = fs.create(draft, False)
        out.write(bytearray(f'{{"number": {number}, "token": "{token}"}}\n'.encode()))
        out.close()
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(draft, at, no_overwrite)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def table(self, until: int, since: int = 0) -> DataFrame:
        """(token, number) of the commits after since, up to until: a row a commit."""
        schema = "number BIGINT, token STRING"
        if until <= since:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.path).where((F.col("number") <= until) & (F.col("number") > since))
