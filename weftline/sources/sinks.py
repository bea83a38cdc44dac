"""Where results go: reports in JSON, CSV, text and HTML, table files, artifact stores, databases and topics.

Everything is written by executors. A report that is to be one file is one small table: a line for each result, coalesced by the writer.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import report as R
from weftline.operators.jobs import edges, report_rows

_COLUMNS = ("url", "status", "depth", "content_type", "success", "error", "links", "images", "keywords", "keyphrases", "tables")
_KINDS = {"url": "string", "status": "int", "depth": "int", "content_type": "string", "success": "boolean", "error": "string", "links": "array<string>", "images": "array<struct<src:string,alt:string>>", "keywords": "array<string>", "keyphrases": "array<string>", "tables": "array<array<array<string>>>"}


def whole(results: DataFrame) -> DataFrame:
    """results with all the columns of a report; those that are missing are null."""
    return results.select(*[F.col(c) if c in results.columns else F.lit(None).cast(_KINDS[c]).alias(c) for c in _COLUMNS])


def _cells(results: DataFrame) -> list[Column]:
    return [F.col(c) for c in _COLUMNS]


def _html(results: DataFrame) -> DataFrame:
    d = whole(results)
    return report_rows(d.select("url", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("links", F.array().cast("array<string>")).alias("links"))).select("row")


def save_results(results: DataFrame, path: str, kind: str, stamp: str, mode: str = "error") -> None:
    """Results as json (a line each, without html), csv (eleven columns), txt or html; a first line or header row, and the totals, go with them. kind in any case; ValueError for others.

    txt and html keep a title, the results by URL, and an end in one file: the rows are sorted and written by one task a file, and
    `spark.sql.files.maxRecordsPerFile` splits what is too large for one.
    """
    kind = kind.lower()
    if kind == "json":
        kept = [c for c in results.columns if c not in ("html", "html_content", "raw_html")]
        results.select(F.lit(stamp).alias("timestamp"), *kept).write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        d = whole(results)
        d.select(*R.csv_row(*_cells(d))).write.mode(mode).option("header", True).csv(path)
    elif kind == "txt":
        d = whole(results)
        body = d.select(F.lit(1).alias("at"), F.col("url"), F.concat(R.text_entry(*_cells(d)), F.lit("\n" + "-" * 40 + "\n")).alias("value"))
        head = d.agg(F.count("*").alias("n")).select(F.lit(0).alias("at"), F.lit("").alias("url"), F.concat(F.lit(f"Crawl Results - Generated at {stamp}\nTotal URLs: "), F.col("n").cast("string"), F.lit("\n" + "=" * 80 + "\n")).alias("value"))
        head.unionByName(body).repartitionByRange(1, "at").sortWithinPartitions("at", "url").select("value").write.mode(mode).text(path)
    elif kind == "html":
        n = whole(results).agg(F.count("*").alias("total"), F.count_if("success").alias("ok"))
        head = n.select(F.lit(0).alias("at"), F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Crawl results</title></head><body><p>" + stamp + ": "), F.col("total").cast("string"), F.lit(" URLs, "), F.col("ok").cast("string"), F.lit(" successful, "), (F.col("total") - F.col("ok")).cast("string"),
                                                       F.lit(" failed</p><table><tr><th>URL</th><th>Depth</th><th>Status</th><th>Links</th></tr>")).alias("value"))
        tail = n.select(F.lit(2).alias("at"), F.lit("</table></body></html>").alias("value"))
        body = _html(results).select(F.lit(1).alias("at"), F.col("row").alias("value"))
        head.unionByName(body).unionByName(tail).repartitionByRange(1, "at").sortWithinPartitions("at", "value").select("value").write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown kind of report: {kind}")


def save_tables(tables: DataFrame, path: str, kind: str = "csv", mode: str = "error") -> None:
    """tables(name, tables as extract("tables") gives them): a folder `table=<name>_<number from 1>` for each table; csv rows, or json with headers and data."""
    t = tables.select("name", F.posexplode("tables").alias("i", "t")).select(F.concat("name", F.lit("_"), (F.col("i") + 1).cast("string")).alias("table"), "t")
    if kind == "json":
        rows = t.select("table", F.to_json(F.struct(F.element_at("t", 1).alias("headers"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("data"))).alias("value"))
    elif kind == "csv":
        quoted = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        rows = t.select("table", F.array_join(F.transform("t", lambda r: F.array_join(F.transform(r, quoted), ",")), "\n").alias("value"))
    else:
        raise ValueError(f"unknown kind of table file: {kind}")
    rows.repartition("table").write.mode(mode).partitionBy("table").text(path)


def manifest(run_id: str, settings: dict, started: str, seeds: list[str]) -> dict:
    """A run's description; config_hash is that of the settings with sorted names."""
    return {"run_id": run_id, "layout": "1", "schema_version": "1", "started_at": started, "seed_urls": seeds, "config_hash": hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16], "config": settings}


def save_artifacts(spark: SparkSession, artifacts: DataFrame, events: DataFrame, path: str, run: dict, mode: str = "append") -> None:
    """A run's store: run.json, artifacts.jsonl and edges.jsonl and events.jsonl (folders of JSON lines), and blobs (a row a content). artifacts: url, html, discovered_from, depth, method and others."""
    spark.createDataFrame([(json.dumps(run, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run.json")
    a = artifacts.withColumn("blob_sha256", F.sha2("html", 256))
    a.drop("html").write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/artifacts.jsonl")
    edges(artifacts).withColumn("run_id", F.lit(run["run_id"])).write.mode(mode).json(f"{path}/edges.jsonl")
    events.write.mode(mode).json(f"{path}/events.jsonl")
    a.filter("html is not null").groupBy("blob_sha256").agg(F.first("html").alias("html")).write.mode(mode).parquet(f"{path}/blobs")


def as_json(df: DataFrame) -> DataFrame:
    """value: each row as JSON, nulls included: what goes to a topic or a file of lines."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def with_error(artifacts: DataFrame, errors: str, when: Column, code: str, message: Column, source: str | None = None, status: Column | None = None) -> DataFrame:
    """artifacts with one more entry in their column of errors (array<struct<code, message, source, http_status>>) where `when` holds."""
    e = F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(source).cast("string").alias("source"), (status.cast("int") if status is not None else F.lit(None).cast("int")).alias("http_status"))
    return artifacts.withColumn(errors, F.when(when, F.concat(F.coalesce(errors, F.array().cast("array<struct<code:string,message:string,source:string,http_status:int>>")), F.array(e))).otherwise(F.col(errors)))


def error_text(e: Column) -> Column:
    """[CODE] (source) message"""
    return F.concat(F.lit("["), e["code"], F.lit("] "), F.when(e["source"].isNotNull(), F.concat(F.lit("("), e["source"], F.lit(") "))).otherwise(""), e["message"])


def save_to_database(results: DataFrame, url: str, crawl: DataFrame, **options: str) -> None:
    """A crawl's row to the table crawls and its results to the table results, by JDBC; columns that the tables lack go in as JSON under metadata."""
    own = ("crawl_id", "url", "status_code", "success", "depth", "content_type", "title", "error")
    rest = [c for c in results.columns if c not in own]
    r = results.select(*[c for c in own if c in results.columns], F.to_json(F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))).alias("metadata"))
    crawl.write.format("jdbc").options(url=url, dbtable="crawls", **options).mode("append").save()
    r.write.format("jdbc").options(url=url, dbtable="results", **options).mode("append").save()


def crawl_row(results: DataFrame, crawl_id, started: str) -> DataFrame:
    """A crawl's row: totals of its results."""
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed")).select(F.lit(crawl_id).alias("crawl_id"), F.lit(started).alias("ts"), "total", "successful", "failed")


def publish(messages: DataFrame, servers: str, topic: str, key: str | None = None, priority: str | None = None) -> None:
    """Rows as JSON to a Kafka topic; a priority from 0 to 10 goes into the message as _priority."""
    d = messages.withColumn("_priority", F.least(F.greatest(F.col(priority), F.lit(0)), F.lit(10))) if priority else messages
    d.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct(*d.columns)).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def event(run_id: Column, kind: str, url: Column, at: Column, level: str = "INFO", **details: Column) -> Column:
    """An entry of the event log; details as JSON."""
    more = F.to_json(F.struct(*[c.alias(k) for k, c in details.items()])) if details else F.lit("{}")
    return F.struct(run_id.alias("run_id"), at.alias("ts"), F.lit(level).alias("level"), F.lit(kind).alias("event_type"), url.alias("url"), more.alias("details"))


def logged_events(results: DataFrame) -> DataFrame:
    """The events that results(run_id, url, at, success, status, error, duplicate_of) stand for: page_fetched or fetch_error, and duplicate_content."""
    r = F.col("run_id"), F.col("url"), F.col("at")
    ok = F.when(F.col("success"), event(r[0], "page_fetched", r[1], r[2], status=F.col("status")))
    bad = F.when(~F.col("success"), event(r[0], "fetch_error", r[1], r[2], "ERROR", status=F.col("status"), error=F.col("error")))
    twice = F.when(F.col("duplicate_of").isNotNull(), event(r[0], "duplicate_content", r[1], r[2], original=F.col("duplicate_of")))
    return results.select(F.explode(F.array_compact(F.array(ok, bad, twice))).alias("e")).select("e.*")
