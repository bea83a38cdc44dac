"""Statistics of a crawl's parts: each is one aggregation over the table that stands for the part's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_store_stats(store: DataFrame) -> DataFrame:
    """hashes, runs and oldest of a store(sha256, first_seen_at, run_id)."""
    return store.agg(F.count("*").alias("hashes"), F.countDistinct("run_id").alias("runs"), F.min("first_seen_at").alias("oldest"))


def state_stats(state: DataFrame) -> DataFrame:
    """pages, with_etag, with_last_modified and mean crawl count, to two places, of a state(etag, last_modified, crawl_count)."""
    return state.agg(F.count("*").alias("pages"), F.count("etag").alias("with_etag"), F.count("last_modified").alias("with_last_modified"), F.round(F.coalesce(F.avg("crawl_count"), F.lit(0.0)), 2).alias("mean_crawls"))


def progress_stats(results: DataFrame) -> DataFrame:
    """crawled, successful, failed, links, deepest, elapsed seconds, URLs a second and success rate of results(success, n_links, depth, at in seconds)."""
    a = results.agg(F.count("*").alias("crawled"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("links"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"),
                    F.coalesce(F.max("at") - F.min("at"), F.lit(0)).cast("double").alias("elapsed"))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return a.withColumn("rate", share(F.col("crawled"), F.col("elapsed"))).withColumn("success_rate", share(F.col("successful"), F.col("crawled")))


def rate_stats(responses: DataFrame, key: str, delays: DataFrame | None = None, default: float = 0.1) -> DataFrame:
    """requests, errors, error_rate, mean_seconds and delay of each key of responses(key, status, seconds); delays(key, delay) override the default."""
    a = responses.groupBy(key).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.avg("seconds").alias("mean_seconds")).withColumn("error_rate", F.col("errors") / F.col("requests"))
    return with_delay(a, key, delays, default)


def with_delay(df: DataFrame, key: str, delays: DataFrame | None, default: float) -> DataFrame:
    """Adds delay: that of the row's key in delays(key, delay), else the default."""
    if delays is None:
        return df.withColumn("delay", F.lit(float(default)))
    return df.join(delays.select(key, F.col("delay").cast("double").alias("delay")), key, "left").withColumn("delay", F.coalesce("delay", F.lit(float(default))))


def budget_stats(pages: DataFrame, size: str, at: str, max_pages: int | None = None, max_mb: float | None = None, max_seconds: float | None = None) -> DataFrame:
    """pages, bytes, mb, seconds, what is used of each limit in percent, and the first limit that is used up (pages, bandwidth, time), if any."""
    a = pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.max(at) - F.min(at), F.lit(0)).cast("double").alias("seconds")).withColumn("mb", F.col("bytes") / (1024 * 1024))
    over = F.lit(None).cast("string")
    for name, value, most in (("time", "seconds", max_seconds), ("bandwidth", "mb", max_mb), ("pages", "pages", max_pages)):
        used = F.lit(None).cast("double") if most is None else F.col(value) / F.lit(float(most)) * 100
        a = a.withColumn(f"{name}_percent", used)
        over = F.when(used >= 100, name).otherwise(over)
    return a.withColumn("exceeded", over)


def file_allowed(size: Column, max_file_mb: float | None) -> Column:
    """Whether a file may be downloaded; of unknown size, or without a limit, it may."""
    return F.lit(True) if max_file_mb is None else F.coalesce(size <= max_file_mb * 1024 * 1024, F.lit(True))


def cache_stats(cached: DataFrame, at: str, now: Column, ttl_seconds: int, size: Column) -> DataFrame:
    """entries, valid ones, expired ones and bytes of a cache."""
    ok = F.col(at) > now - F.make_interval(secs=F.lit(ttl_seconds))
    return cached.agg(F.count("*").alias("entries"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("expired"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def task_stats(tasks: DataFrame) -> DataFrame:
    """Tasks in all and by state, the workers that took some, and the share that is done, of tasks(state: pending, running, done or failed; worker)."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return tasks.agg(F.count("*").alias("tasks"), n("pending"), n("running"), n("done"), n("failed"), F.countDistinct("worker").alias("workers"), F.coalesce(F.count_if(F.col("state") == "done") / F.count("*"), F.lit(0.0)).alias("share_done"))


def token_stats(stored: DataFrame, shared: dict[str, str] | None = None) -> DataFrame:
    """urls, tokens and the distinct names (sorted) of stored(url, tokens map) and of the tokens that all requests share."""
    known = shared or {}
    names = F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_set(F.map_keys("tokens"))), F.array(*[F.lit(k) for k in sorted(known)]).cast("array<string>"))))
    return stored.agg(F.count("*").alias("urls"), (F.coalesce(F.sum(F.size("tokens")), F.lit(0)) + len(known)).alias("tokens"), names.alias("names"))


def duplicate_urls(pages: DataFrame, content_hash: str) -> DataFrame:
    """url, hash, others: the number of further URLs with the same content, for contents of several; the URLs themselves are the rows of equal hash."""
    n = pages.groupBy(content_hash).agg(F.count("*").alias("_n")).filter(f"_n > 1 and {content_hash} is not null")
    return pages.join(n, content_hash).select("url", F.col(content_hash).alias("hash"), (F.col("_n") - 1).alias("others"))


def joined_events(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, url, event_type, level and the artifact's status: events(run_id, url, event_type, level) of artifacts(run_id, url, status)."""
    return events.join(artifacts.select("run_id", "url", "status"), ["run_id", "url"])


def cached_or_not(urls: DataFrame, cache: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """urls(url) with cached: whether the cache(url, at) holds the URL and the entry hasn't expired."""
    live = cache.filter(F.col(at) > now - F.make_interval(secs=F.lit(ttl_seconds))).select("url").distinct().withColumn("cached", F.lit(True))
    return urls.join(live, "url", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
