"""Keyed and ordered state as windows: rates, budgets, rolling figures, rotation, first-seen, priority."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scheduled_starts(requests: DataFrame, key: str, at: str, order: str, delay: float) -> DataFrame:
    """Adds start: when each request may start if its key's requests stay `delay` apart. s_i = max(t_i, s_{i-1} + d) as a running maximum of t_j - j d."""
    w = Window.partitionBy(key).orderBy(at, order)
    d = requests.withColumn("_i", F.row_number().over(w) - 1)
    return d.withColumn("start", F.max(F.col(at) - F.col("_i") * F.lit(delay)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * F.lit(delay)).drop("_i")


def must_wait(requests: DataFrame, key: str, at: str, order: str, delay: float) -> DataFrame:
    """Adds wait: what is missing to the delay since the key's last request; 0 for the first."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at, order))
    return requests.withColumn("wait", F.greatest(F.lit(0.0), F.coalesce(F.lit(delay) - gap, F.lit(0.0))))


def rolling_mean(df: DataFrame, key: str, order: list[str], value: str, last: int = 10, least: int = 5) -> DataFrame:
    """Adds rolling: the mean of the last values of a key, null before there are `least`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(last - 1), 0)
    return df.withColumn("rolling", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def within_budget(df: DataFrame, key: str, order: list[str], size: str, max_items: int | None = None, max_size: float | None = None, max_seconds: float | None = None, at: str | None = None) -> DataFrame:
    """Rows of each key before its budget of items, of summed size or of time (of column at, from its first row on) is used up: a row goes in while what came before is under all."""
    if max_seconds is not None:
        df = df.withColumn("_first", F.min(at).over(Window.partitionBy(key))).filter(F.col(at) - F.col("_first") < max_seconds).drop("_first")
    if max_items is None and max_size is None:
        return df
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_s", F.coalesce(F.sum(size).over(w), F.lit(0)))
    if max_items is not None:
        d = d.filter(F.col("_n") < max_items)
    if max_size is not None:
        d = d.filter(F.col("_s") < max_size)
    return d.drop("_n", "_s")


def first_seen(df: DataFrame, content_hash: Column, order: str, name: str) -> DataFrame:
    """Adds hash, duplicate and duplicate_of (name of the first row with the hash). Rows of a null hash are never duplicates.

    The first row of each hash comes from an aggregation that begins before the shuffle, so that a content with very many copies isn't
    sorted in one task; only hashes of several rows are joined back. Rows of equal order count as first together.
    """
    d = df.withColumn("hash", content_hash)
    first = d.filter("hash is not null").groupBy("hash").agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1").drop("_rows")
    dup = F.col("_first").isNotNull() & (F.col(order) > F.col("_first.o"))
    # rows without a hash get keys of their own and don't gather in one task
    key = F.coalesce(F.col("hash").cast("string"), F.concat(F.lit("\0"), F.col(order).cast("string")))
    j = d.withColumn("_key", key).join(first.select(F.col("hash").cast("string").alias("_key"), "_first"), "_key", "left")
    return j.withColumn("duplicate", dup).withColumn("duplicate_of", F.when(dup, F.col("_first.n"))).drop("_key", "_first")


def rotated(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Adds slot: which of n proxies a key's request takes in turn."""
    return df.withColumn("slot", F.pmod(F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1, F.lit(n)))


def prioritized(df: DataFrame, priority: Column, key: str, order: str, capacity: int | None = None) -> DataFrame:
    """Adds priority and position in each key's queue (ties by order); keeps what the queue's capacity holds."""
    d = df.withColumn("priority", priority)
    d = d.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("priority", order)))
    return d.filter(F.col("position") <= capacity) if capacity is not None else d


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds unique_name: the n-th equal name gets _n before its extension."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, ext = F.regexp_extract(name, r"^(.+?)([.][^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)([.][^.]*)?$", 2)
    return df.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def next_delay(delay: float, base: float, status: int, seconds: float, retry_after: float | None, recent: list[float], errors: int, requests: int, least: float = 0.1, most: float = 60.0, factor: float = 1.5) -> float:
    """A domain's delay after a response: up on 429, on server errors and slow answers, down on fast ones."""
    if status == 429:
        return min(most, retry_after if retry_after else max(delay * factor * 2, base))
    if status >= 500:
        return min(most, delay * factor)
    if requests >= 10 and errors / requests > 0.1:
        return min(most, delay * factor)
    if len(recent) >= 5:
        mean = sum(recent) / len(recent)
        if mean > 2.0:
            return min(most, delay * 1.2)
        if mean < 0.5:
            return max(least, delay * 0.9)
    return delay


def adapted_delays(responses: DataFrame, key: str, order: str, base: float = 0.1) -> DataFrame:
    """The delay of each key after each of its responses. Columns: the key, order, status, seconds, retry_after (nullable). The recurrence depends on all that came before, so each key is one pass."""
    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(order, kind="stable")
        delay, recent, errors, out = base, [], 0, []
        for i, (status, seconds, after) in enumerate(zip(d["status"], d["seconds"], d["retry_after"]), 1):
            recent = [*recent, float(seconds)][-10:]
            errors += int(status) >= 400
            delay = next_delay(delay, base, int(status), float(seconds), None if pd.isna(after) else float(after), recent, errors, i)
            out.append(delay)
        return pd.DataFrame({key: d[key], order: d[order], "delay": out})

    kinds = {f.name: f.dataType.simpleString() for f in responses.schema.fields}
    return responses.select(key, order, "status", "seconds", "retry_after").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, delay double")
