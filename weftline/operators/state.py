"""State tables between runs: content hashes, incremental re-crawling, caches; and reports over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recrawl_decisions(current: DataFrame, state: DataFrame, force: Column | None = None, oldest: Column | None = None) -> DataFrame:
    """url, crawl and reason of current(url, etag, last_modified, content_hash) against state of the same columns and last_crawled.

    The first of these decides: force (a condition on current), a new URL, a last crawl before `oldest`; then the first of etag, last_modified
    and content hash that both sides have, whether it matches or not. Without any the URL is crawled.
    """
    s = state.select("url", *[F.col(c).alias(f"_{c}") for c in ("etag", "last_modified", "content_hash", *(["last_crawled"] if oldest is not None else []))], F.lit(True).alias("_known"))
    reason = F.when(F.coalesce(force, F.lit(False)), "forced").when(F.col("_known").isNull(), "new_url") if force is not None else F.when(F.col("_known").isNull(), "new_url")
    if oldest is not None:
        reason = reason.when(F.col("_last_crawled") < oldest, "expired")
    for c, name in (("etag", "etag"), ("last_modified", "last_modified"), ("content_hash", "content")):
        both = F.col(c).isNotNull() & F.col(f"_{c}").isNotNull()
        reason = reason.when(both & (F.col(c) == F.col(f"_{c}")), f"{name}_match").when(both, f"{name}_changed")
    return current.join(s, "url", "left").withColumn("reason", reason.otherwise("no_comparison_data")).select("url", (~F.col("reason").endswith("_match")).alias("crawl"), "reason")


def without_urls(table: DataFrame, urls: DataFrame) -> DataFrame:
    """A state or cache without the rows of urls(url)."""
    return table.join(urls.select("url").distinct(), "url", "left_anti")


def with_entries(cache: DataFrame, new: DataFrame) -> DataFrame:
    """A cache(url, ...) in which new rows take the place of those of their URLs."""
    return without_urls(cache, new).unionByName(new)


def kept_html(pages: DataFrame, mode: str, html: str = "html") -> tuple[DataFrame, DataFrame | None]:
    """pages and, apart from them, what is to be stored: mode memory leaves html in place, file moves it to a table (name, html) that the column stored names, none drops it."""
    if mode == "memory":
        return pages, None
    if mode not in ("file", "none"):
        raise ValueError(f"unknown mode of storage: {mode}")
    if mode == "none":
        return pages.drop(html), None
    name = F.concat(F.md5("url"), F.lit(".html"))
    there = F.col(html).isNotNull()
    return pages.withColumn("stored", F.when(there, name)).drop(html), pages.filter(there).select(name.alias("name"), html)


def conditional_headers(state: DataFrame) -> DataFrame:
    """url and the request headers that ask for changes only."""
    e = F.array_compact(F.array(F.when(F.col("etag").isNotNull(), F.struct(F.lit("If-None-Match").alias("k"), F.col("etag").alias("v"))),
                                F.when(F.col("last_modified").isNotNull(), F.struct(F.lit("If-Modified-Since").alias("k"), F.col("last_modified").alias("v")))))
    return state.select("url", F.map_from_entries(e).alias("headers"))


def merged_state(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """state(url, etag, last_modified, content_hash, last_crawled, crawl_count) after fetched(same without crawl_count): the last fetch of a URL counts, each adds to its count."""
    last = F.max_by(F.struct("etag", "last_modified", "content_hash"), "last_crawled").alias("s")
    n = fetched.groupBy("url").agg(last, F.max("last_crawled").alias("_at"), F.count("*").alias("_n"))
    j = state.join(n, "url", "full")
    pick = lambda c: F.when(F.col("_n").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c)
    return j.select("url", *[pick(c) for c in ("etag", "last_modified", "content_hash")], F.coalesce("_at", "last_crawled").alias("last_crawled"), (F.coalesce("crawl_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int").alias("crawl_count"))


def record_hashes(store: DataFrame, found: DataFrame) -> DataFrame:
    """store(sha256, url, first_seen_at, run_id) with the hashes of found that it lacks, each by its first row."""
    new = found.groupBy("sha256").agg(F.min_by(F.struct("url", "first_seen_at", "run_id"), F.struct("first_seen_at", "url")).alias("r")).select("sha256", "r.url", "r.first_seen_at", "r.run_id")
    return store.select("sha256", "url", "first_seen_at", "run_id").unionByName(new.join(store.select("sha256"), "sha256", "left_anti"))


def fresh(cached: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows of a cache that haven't expired."""
    return cached.filter(F.col(at) > now - F.make_interval(secs=F.lit(ttl_seconds)))


def summary(results: DataFrame, by: str = "depth") -> DataFrame:
    """total, successful, failed and links over all results (a null in `by`) and for each value: one pass of grouping sets."""
    return results.rollup(by).agg(F.count("*").alias("total"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.sum("n_links").alias("links"))


def blob_path(sha: Column, ext: str = "html") -> Column:
    return F.concat(F.lit(f"{ext}/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(f".{ext}"))


def artifact_problems(url: Column, version: Column, fetched_at: Column) -> Column:
    """What is wrong with an artifact; an empty array where nothing is."""
    return F.array_compact(F.array(F.when(F.coalesce(url, F.lit("")) == "", F.lit("url is empty")), F.when(~F.coalesce(url, F.lit("")).rlike("^https?://"), F.lit("url has no http scheme")),
                                   F.when(F.coalesce(version, F.lit("")) != "1", F.lit("unknown schema version")), F.when(fetched_at.isNull(), F.lit("fetched_at is missing"))))


def unexpired_cookies(cookies: DataFrame, now: Column, domain: str | None = None) -> DataFrame:
    """cookies(domain, expires, ...) that haven't expired and, if a domain is given, belong to it or to part of it; an empty domain belongs to all."""
    d = cookies.filter(F.col("expires").isNull() | (F.col("expires") >= now))
    if domain is None:
        return d
    own = F.ltrim(F.coalesce("domain", F.lit("")), F.lit("."))
    return d.filter((own == "") | F.lit(domain).endswith(own) | own.endswith(domain))
