"""Command line: python -m weftline.cli QUERY FOLDER [-o OUT] [-f json|csv|parquet], --list, or --crawl URL -o FOLDER."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description="Runs a query over a folder of Parquet tables, or crawls a site into one.")
    p.add_argument("query", nargs="?", help="name of a query (--list shows all)")
    p.add_argument("folder", nargs="?", help="folder of the tables")
    p.add_argument("-o", "--output", help="where the result goes; it is shown where this is missing")
    p.add_argument("-f", "--format", choices=("json", "csv", "parquet", "txt", "html"), default="parquet")
    p.add_argument("--list", action="store_true", help="names of the queries")
    p.add_argument("--crawl", metavar="URL", help="fetch from here on")
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("--all-hosts", action="store_true", help="follow links to other hosts too")
    p.add_argument("--same-path", action="store_true", help="stay below the first URL's path")
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--user-agent", default="weftline/1")
    p.add_argument("--timeout", type=float, default=10.0)
    p.add_argument("--retries", type=int, default=3)
    p.add_argument("--rows", type=int, default=20, help="rows that are shown")
    return p


def crawl(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from weftline.functions import urls as U
    from weftline.operators import crawl as C
    from weftline.sources import fetch as W

    get = W.HttpFetcher(user_agent=a.user_agent, timeout=a.timeout, retries=a.retries)
    seeds = spark.createDataFrame([(a.crawl,)], "url string")
    base, start = seeds.select(U.netloc(F.col("url")), U.path(F.col("url"))).first()

    def keep(frontier: DataFrame) -> DataFrame:
        d = frontier.filter(U.in_scope(F.col("url"), base, start or "/", not a.all_hosts, a.same_path)).withColumn("domain", U.netloc(F.col("url"))).withColumn("path", U.path(F.col("url")))
        if not a.ignore_robots:
            texts = W.robots_texts(d, get, a.crawl.split(":")[0]).filter("text is not null")
            d = C.robots_allowed(d, C.robots_rules(texts), a.user_agent.split("/")[0]).filter("allowed")
        return d.select("url", "depth", "discovered_from")

    return W.spider(seeds, a.depth, keep, a.output, get, U.netloc)


def main(args: list[str] | None = None) -> int:
    from weftline.plans import registry
    from weftline.sources import sinks

    a = parser().parse_args(args)
    if a.list:
        print("\n".join(sorted(registry.queries())))
        return 0
    if a.crawl and a.output:
        spark = SparkSession.builder.appName("weftline").getOrCreate()
        crawl(spark, a).groupBy("depth").agg(F.count("*").alias("pages"), F.count_if("success").alias("successful")).orderBy("depth").show()
        return 0
    if not a.query or not a.folder or a.query not in registry.queries():
        print("name a query (--list) and a folder, or --crawl URL with -o FOLDER", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    df = registry.queries()[a.query](spark, a.folder)
    if not a.output:
        df.show(a.rows, truncate=60)
    elif a.format == "parquet":
        df.write.parquet(a.output)
    elif a.format == "csv":
        from weftline.sources.tables import write_csv

        write_csv(df, a.output, "error")
    elif a.format == "json":
        df.write.json(a.output)
    else:
        sinks.save_results(df, a.output, a.format, "")
    return 0


if __name__ == "__main__":
    sys.exit(main())
