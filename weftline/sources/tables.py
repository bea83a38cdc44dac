"""Reading and writing: Parquet tables, JSON lines, page files, databases, and the file layouts of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by hashes of keys, in some parts for every core: a file of few MB may hold more rows than one task should work on in Python."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(n, *keys)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; what can't be read becomes a row of nulls, and nothing is inferred."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and charset of HTML files."""
    d = spark.read.format("binaryFile").load(path)
    return d.select("path", F.col("content").alias("bytes"), charset(F.col("content")).alias("charset"))


def charset(raw: Column) -> Column:
    """The character set that a page's first 4096 bytes declare, in lower case; null without one."""
    head = F.decode(F.substring(raw, 1, 4096), "ISO-8859-1")
    tag = F.regexp_extract(head, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1)
    return F.lower(F.coalesce(F.nullif(tag, F.lit("")), F.nullif(F.regexp_extract(head, r"(?i)charset=[\"']?([\w-]+)", 1), F.lit(""))))


def is_pdf(content_type: Column, raw: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False)) | F.coalesce(F.hex(F.substring(raw, 1, 5)) == "255044462D", F.lit(False))


def pdf_metadata(raw: Column) -> Column:
    """A PDF's properties by their usual names: without the slash, in lower case, dates as creation_date and modification_date; without those that are null."""
    key = lambda k: F.lower(F.regexp_replace(k, "^/+", ""))
    named = lambda k: F.when(key(k) == "creationdate", "creation_date").when(key(k) == "moddate", "modification_date").otherwise(key(k))
    return F.transform_keys(F.map_filter(raw, lambda _, v: v.isNotNull()), lambda k, _: named(k))


def is_html(content_type: Column) -> Column:
    return F.lower(F.trim(F.split(content_type, ";")[0])) == "text/html"


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested columns go in as JSON."""
    flat = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields])
    flat.write.mode(mode).option("header", True).csv(path)


def write_blobs(pages: DataFrame, path: str, text: str = "html") -> None:
    """One row for each distinct content, partitioned by the first two characters of its hash."""
    d = pages.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("sha256"), F.col(text).alias("content")).groupBy("sha256").agg(F.first("content").alias("content"))
    d.withColumn("prefix", F.substring("sha256", 1, 2)).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(path)


def database(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A JDBC table; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def found_results(results: DataFrame, crawl_id=None, url_part: str | None = None, status: int | None = None, success: bool | None = None) -> DataFrame:
    """Results that meet all the conditions given; the part of a URL in any case."""
    for c in ((F.col("crawl_id") == crawl_id) if crawl_id is not None else None, F.col("url").ilike("%" + url_part.replace("%", r"\%").replace("_", r"\_") + "%") if url_part else None,
              (F.col("status_code") == status) if status is not None else None, (F.col("success") == success) if success is not None else None):
        results = results.filter(c) if c is not None else results
    return results


def latest(crawls: DataFrame, limit: int = 10) -> DataFrame:
    """The last crawls; the greater id first among equals."""
    return crawls.orderBy(F.desc("ts"), F.desc("crawl_id")).limit(limit)
