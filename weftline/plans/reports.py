"""Rollup reports, state between runs, filters over stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import ship
from weftline.functions import urls as U
from weftline.operators import state as S
from weftline.sources import tables as R

#: How pages stand in for results of a crawl: a depth, a success and a number of links from their ids and URLs.


def _results(spark, d):
    ship(spark)
    u = F.col("url")
    return R.table(spark, d, "pages").select("page_id", "url", U.netloc(u).alias("host"), F.pmod("page_id", F.lit(4)).cast("int").alias("depth"), (F.pmod("page_id", F.lit(7)) != 0).alias("success"),
                                             F.when(F.pmod("page_id", F.lit(7)) == 0, 404).otherwise(200).alias("status_code"), F.pmod("page_id", F.lit(3)).cast("int").alias("crawl_id"), F.size(F.regexp_extract_all("html", F.lit("(<a href=)"), 1)).alias("n_links"), "html")


def summary_report(spark, d):
    return S.summary(_results(spark, d))


def host_report(spark, d):
    return _results(spark, d).groupBy("host").agg(F.count("*").alias("pages"), F.round(100 * F.count_if("success") / F.count("*"), 6).alias("success_rate"), F.max("depth").alias("max_depth"), F.sum(F.octet_length("html")).alias("bytes"))


def depth_histogram(spark, d):
    return _results(spark, d).groupBy("depth").agg(F.count("*").alias("n"), F.min("url").alias("first"), F.max("url").alias("last"))


def stored_results(spark, d):
    return R.found_results(_results(spark, d), crawl_id=1, url_part="EXAMPLE.org", success=True).select("page_id", "url", "depth")


def crawl_totals(spark, d):
    """Results of a crawl joined with the crawl's row."""
    r = _results(spark, d)
    crawls = r.groupBy("crawl_id").agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.max("page_id").alias("ts"))
    return r.join(crawls, "crawl_id").groupBy("crawl_id", "total", "successful", "ts").agg(F.sum("n_links").alias("links"))


def latest_crawls(spark, d):
    """The last two crawls: the limit is what the operator is for."""
    return R.latest(_results(spark, d).groupBy("crawl_id").agg(F.max("page_id").alias("ts")), 2)


def _state(spark, d):
    """All documents now, and what is known of all of them from before: under other URLs of every third, without etags of every fourth, with another etag of every seventh and another content of every eighth; every thirteenth was seen long ago."""
    k = F.col("doc_id")
    x = R.table(spark, d, "documents").select(k.cast("string").alias("url"), F.concat(F.lit("e"), F.pmod(k, F.lit(5)).cast("string")).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.md5("text").alias("content_hash"), "doc_id")
    old = x.select(F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("old-"), "url")).otherwise(F.col("url")).alias("url"), F.when((F.pmod(k, F.lit(4)) > 0) & (F.pmod(k, F.lit(7)) == 0), F.lit("was")).when(F.pmod(k, F.lit(4)) > 0, F.col("etag")).alias("etag"), "last_modified",
                   F.when(F.pmod(k, F.lit(8)) == 0, F.lit("x")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.pmod(k, F.lit(13)) == 0, -5).otherwise(0).cast("long").alias("last_crawled"), F.lit(1).alias("crawl_count"))
    return x, old


def recrawl(spark, d):
    now, old = _state(spark, d)
    return S.recrawl_decisions(now, old, F.pmod("doc_id", F.lit(11)) == 0, F.lit(-1))


def state_after(spark, d):
    now, old = _state(spark, d)
    m = S.merged_state(old, now.withColumn("last_crawled", F.lit(9).cast("long")).drop("doc_id"))
    return m.select("url", "etag", "content_hash", "last_crawled", "crawl_count")


def validators(spark, d):
    _, old = _state(spark, d)
    return S.conditional_headers(old).select("url", F.col("headers")["If-None-Match"].alias("if_none_match"), F.size("headers").alias("n"))


def artifact_checks(spark, d):
    p = _results(spark, d)
    u = F.when(F.pmod("page_id", F.lit(5)) == 0, F.lit("")).otherwise(F.col("url"))
    return p.select("page_id", F.array_join(S.artifact_problems(u, F.when(F.pmod("page_id", F.lit(6)) == 0, F.lit("0")).otherwise(F.lit("1")), F.lit(1)), ";").alias("problems"))


def fresh_cache(spark, d):
    e = R.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("cached_at"))
    now = e.agg(F.max("cached_at").alias("now"))
    return S.fresh(e.crossJoin(F.broadcast(now)), "cached_at", F.col("now"), 7 * 86400).select("event_id")


def event_report(spark, d):
    e = R.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum("k").alias("k"), F.round(F.avg("value"), 6).alias("mean"))


_R = r"""r AS (SELECT page_id, url, regexp_extract(url,'//([^/?#]*)',1) AS host, (page_id % 4)::INT AS depth, page_id % 7 <> 0 AS success, (page_id % 3)::INT AS crawl_id, len(regexp_extract_all(html,'<a href=')) AS n_links, html FROM pages)"""
_S = """x AS (SELECT doc_id::VARCHAR AS url, 'e' || (doc_id % 5) AS etag, md5(text) AS content_hash, doc_id FROM documents), o AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'old-' || url ELSE url END AS url, CASE WHEN doc_id % 4 > 0 AND doc_id % 7 = 0 THEN 'was' WHEN doc_id % 4 > 0 THEN etag END AS etag, CASE WHEN doc_id % 8 = 0 THEN 'x' ELSE content_hash END AS content_hash, CASE WHEN doc_id % 13 = 0 THEN -5 ELSE 0 END::BIGINT AS seen FROM x)"""
QUERIES = {
    "summary_report": (summary_report, f"WITH {_R} SELECT depth, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, sum(n_links)::BIGINT AS links FROM r GROUP BY ROLLUP (depth)"),
    "host_report": (host_report, f"WITH {_R} SELECT host, count(*) AS pages, round(100 * count(*) FILTER (success) / count(*), 6) AS success_rate, max(depth) AS max_depth, sum(strlen(html))::BIGINT AS bytes FROM r GROUP BY host"),
    "depth_histogram": (depth_histogram, f"WITH {_R} SELECT depth, count(*) AS n, min(url) AS first, max(url) AS last FROM r GROUP BY depth"),
    "stored_results": (stored_results, f"WITH {_R} SELECT page_id, url, depth FROM r WHERE crawl_id = 1 AND success AND url ILIKE '%example.org%'"),
    "crawl_totals": (crawl_totals, f"WITH {_R} SELECT crawl_id, count(*) AS total, count(*) FILTER (success) AS successful, max(page_id) AS ts, sum(n_links)::BIGINT AS links FROM r GROUP BY crawl_id"),
    "latest_crawls": (latest_crawls, f"WITH {_R} SELECT crawl_id, max(page_id) AS ts FROM r GROUP BY crawl_id ORDER BY ts DESC, crawl_id DESC LIMIT 2"),
    "recrawl": (recrawl, f"""WITH {_S} SELECT url, reason NOT LIKE '%_match' AS crawl, reason FROM (SELECT x.url, CASE WHEN x.doc_id % 11 = 0 THEN 'forced' WHEN o.url IS NULL THEN 'new_url' WHEN o.seen < -1 THEN 'expired' WHEN o.etag = x.etag THEN 'etag_match' WHEN o.etag <> x.etag THEN 'etag_changed'
 WHEN o.content_hash = x.content_hash THEN 'content_match' ELSE 'content_changed' END AS reason FROM x LEFT JOIN o USING (url))"""),
    "state_after": (state_after, f"""WITH {_S}, n AS (SELECT * FROM x) SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.url IS NOT NULL THEN n.etag ELSE o.etag END AS etag, CASE WHEN n.url IS NOT NULL THEN n.content_hash ELSE o.content_hash END AS content_hash,
 CASE WHEN n.url IS NOT NULL THEN 9 ELSE o.seen END::BIGINT AS last_crawled, ((o.url IS NOT NULL)::INT + (n.url IS NOT NULL)::INT) AS crawl_count FROM o FULL JOIN n ON o.url = n.url"""),
    "validators": (validators, f"WITH {_S} SELECT url, etag AS if_none_match, (etag IS NOT NULL)::INT AS n FROM o"),
    "artifact_checks": (artifact_checks, "SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 5 = 0 THEN 'url is empty;url has no http scheme' END, CASE WHEN page_id % 6 = 0 THEN 'unknown schema version' END], lambda x: x IS NOT NULL), ';') AS problems FROM pages"),
    "fresh_cache": (fresh_cache, "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY"),
    "event_report": (event_report, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum((props->>'$.k')::INT)::BIGINT AS k, round(avg(value), 6) AS mean FROM events GROUP BY event_type"),
}
