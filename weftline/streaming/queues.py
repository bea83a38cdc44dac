"""Queues of messages as folders of JSON lines in shared storage: the same contract as a topic of a broker, without one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FileQueue:
    """name: a folder below `folder`. schema: of the messages. What was consumed is what the consumer's checkpoint says, as with offsets of a topic."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path, self.checkpoint = f"{folder}/{name}/messages", f"{folder}/{name}/consumers"

    def publish(self, messages: DataFrame, priority: str | None = None) -> None:
        """Appends rows; priority (a column of 0 to 10) goes with the message as _priority."""
        d = messages.withColumn("_priority", F.least(F.greatest(F.col(priority), F.lit(0)), F.lit(10)).cast("int")) if priority else messages
        d.write.mode("append").option("ignoreNullFields", "false").json(self.path)

    def size(self) -> int:
        """Messages published, consumed ones included."""
        return self.spark.read.schema(self.schema).json(self.path).count() if self._there() else 0

    def purge(self) -> None:
        self._files().delete(self._at(self.path), True)

    def delete(self) -> None:
        self.purge()
        self._files().delete(self._at(self.checkpoint), True)

    def consume(self, handle: Callable[[DataFrame, int], None], consumer: str = "default", files_per_batch: int = 100) -> None:
        """Gives what the consumer hasn't had yet to `handle`, batch by batch; a batch that raises is given again next time."""
        self._files().mkdirs(self._at(self.path))
        s = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).json(self.path)
        s.writeStream.foreachBatch(handle).option("checkpointLocation", f"{self.checkpoint}/{consumer}").trigger(availableNow=True).start().awaitTermination()

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self) -> bool:
        return self._files().exists(self._at(self.path))
