"""Streams of crawl events: windowed counts with late data, first-seen content, and delays that adapt for each domain."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline import scratch
from weftline.operators.ordered import next_delay


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """JSON messages of a topic; the checkpoint takes the place of commits."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v"), "timestamp").select("v.*", F.col("timestamp").alias("received"))


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, kind, n: windows that are complete (the latest event lies `late` or more behind their end), each once; events later than that are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def first_contents(pages: DataFrame, content_hash: str, at: str, late: str = "1 day") -> DataFrame:
    return pages.withWatermark(at, late).dropDuplicatesWithinWatermark([content_hash])


def adapting_delays(responses: DataFrame, key: str, base: float = 0.1) -> DataFrame:
    """key, order and delay after each response, state kept for each key. responses: key, order, status, seconds, retry_after."""
    def run(k, batches, state: GroupState):
        delay, recent, errors, n = state.get if state.exists else (base, [], 0, 0)
        rows = list(batches)  # one key's rows of one trigger, which may come in several chunks
        for d in [pd.concat(rows).sort_values("order", kind="stable")] if rows else []:
            out = []
            for status, seconds, after in zip(d["status"], d["seconds"], d["retry_after"]):
                n += 1
                recent = [*recent, float(seconds)][-10:]
                errors += int(status) >= 400
                delay = next_delay(delay, base, int(status), float(seconds), None if pd.isna(after) else float(after), list(recent), errors, n)
                out.append(delay)
            yield pd.DataFrame({key: k[0], "order": d["order"], "delay": out})
        state.update((delay, list(recent), errors, n))

    kind = dict(responses.dtypes)[key]
    return responses.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, order long, delay double", "delay double, recent array<double>, errors int, n int", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what is there and gives back what it wrote; checkpoint and output lie in the shared folder."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    w = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if each is not None or mode != "append":
        w = w.outputMode(mode).foreachBatch(each or (lambda d, i: d.write.mode("overwrite").parquet(f"{base}/out")))
    else:
        w = w.outputMode("append").format("parquet").option("path", f"{base}/out")
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
