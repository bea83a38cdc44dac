"""Queries of statistics, lookups and rules that join tables; how rows of the given tables stand for a crawl's state is said at each."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import ship
from weftline.functions import urls as U
from weftline.operators import crawl as C
from weftline.operators import jobs as J
from weftline.operators import security as S
from weftline.operators import state as T
from weftline.operators import stats as A
from weftline.operators.extract import extract
from weftline.plans.reports import _results, _state
from weftline.sources.tables import charset, is_html, is_pdf, pdf_metadata, table


def _t(spark, d, name):
    ship(spark)
    return table(spark, d, name)


def hash_store_stats(spark, d):
    x = _t(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("first_seen_at"), F.concat(F.lit("r"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("run_id"))
    return A.hash_store_stats(x)


def state_stats(spark, d):
    now, old = _state(spark, d)
    return A.state_stats(T.merged_state(old, now.withColumn("last_crawled", F.lit(9).cast("long")).drop("doc_id")))


def _responses(spark, d):
    e = _t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return e.select("event_id", "user_id", "at", F.when(F.pmod("event_id", F.lit(6)) == 0, 500).otherwise(200).alias("status"), (F.pmod("event_id", F.lit(31)) / 10.0).alias("seconds"), F.pmod("event_id", F.lit(9)).cast("int").alias("depth"), F.pmod("event_id", F.lit(5)).alias("n_links"), (F.pmod("event_id", F.lit(6)) != 0).alias("success"), (F.col("event_id") * 100).alias("bytes"))


def progress_stats(spark, d):
    r = A.progress_stats(_responses(spark, d))
    return r.select("crawled", "successful", "failed", "links", "deepest", F.round("elapsed", 3).alias("elapsed"), F.round("rate", 9).alias("rate"), F.round("success_rate", 9).alias("success_rate"))


def rate_stats(spark, d):
    """Users as domains; those of even numbers have a delay of their own, in a table of overrides."""
    r = _responses(spark, d)
    own = r.select("user_id").distinct().select("user_id", F.when(F.pmod("user_id", F.lit(2)) == 0, F.col("user_id") / 10.0).alias("delay"))
    a = A.rate_stats(r, "user_id", own)
    return a.select("user_id", "requests", "errors", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("error_rate", 6).alias("error_rate"), "delay")


def budget_stats(spark, d):
    b = A.budget_stats(_responses(spark, d), "bytes", "at", max_pages=1000, max_mb=5000.0, max_seconds=1e9)
    return b.select("pages", "bytes", F.round("mb", 6).alias("mb"), F.round("pages_percent", 6).alias("pages_percent"), F.round("bandwidth_percent", 6).alias("bandwidth_percent"), F.round("time_percent", 6).alias("time_percent"), "exceeded")


def cache_stats(spark, d):
    e = _t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("cached_at"), "event_id")
    now = e.agg(F.max("cached_at").alias("now"))
    return A.cache_stats(e.crossJoin(F.broadcast(now)), "cached_at", F.col("now"), 30 * 86400, F.col("event_id"))


def task_stats(spark, d):
    o = _t(spark, d, "orders").select(F.get(F.array(*[F.lit(s) for s in ("pending", "running", "done", "failed")]), F.pmod("o_orderkey", F.lit(4)).cast("int")).alias("state"), F.pmod("o_custkey", F.lit(7)).alias("worker"))
    return A.task_stats(o).withColumn("share_done", F.round("share_done", 9))


def same_content(spark, d):
    """Documents whose text others have too."""
    x = _t(spark, d, "documents").select(F.col("doc_id").alias("url"), F.md5("text").alias("h"))
    return A.duplicate_urls(x, "h").select("url", "others")


def events_of_artifacts(spark, d):
    """Orders as artifacts of runs (customers), line items as events on them."""
    a = _t(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("status"))
    k = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run_id"))
    e = _t(spark, d, "lineitem").join(k, "l_orderkey").select("run_id", F.col("l_orderkey").alias("url"), F.col("l_linestatus").alias("event_type"), F.lit("INFO").alias("level"))
    return A.joined_events(a, e).groupBy("event_type", "status").agg(F.count("*").alias("n"))


def cache_lookup(spark, d):
    """Pages against a cache whose entries are the events: a page's id is an event's."""
    c = _t(spark, d, "events").select(F.col("event_id").alias("url"), F.col("ts").cast("timestamp").alias("at"))
    now = c.agg(F.max("at").alias("now"))
    return A.cached_or_not(_t(spark, d, "pages").select(F.col("page_id").alias("url")), c.crossJoin(F.broadcast(now)), "at", F.col("now"), 60 * 86400)


def live_cookies(spark, d):
    """Customers as cookies of a few domains that expire at their numbers."""
    c = _t(spark, d, "customer").select("c_custkey", F.get(F.array(*[F.lit(x) for x in ("example.org", ".example.org", "other.net", "")]), F.pmod("c_custkey", F.lit(4)).cast("int")).alias("domain"), F.when(F.pmod("c_custkey", F.lit(5)) > 0, F.col("c_custkey")).alias("expires"))
    return T.unexpired_cookies(c, F.lit(40), "shop.example.org").select("c_custkey")


def composite_order(spark, d):
    """Mean of depth first (weight 1) and sitemap priority (weight 3)."""
    u, depth = F.col("url"), F.size(F.split(U.path(F.col("url")), "/"))
    p = U.composite([(U.priority("dfs", u, depth), 1.0), (U.priority("sitemap", u, depth, F.when(F.pmod("page_id", F.lit(3)) > 0, F.pmod("page_id", F.lit(10)) / 10.0)), 3.0)])
    return _t(spark, d, "pages").select("page_id", F.round(p, 6).alias("priority"))


_ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /\n"


def _found(spark, d):
    return _t(spark, d, "pages").select(U.normalized(F.col("url")).alias("url"), U.netloc(F.col("url")).alias("domain"), U.path(F.col("url")).alias("path"), "page_id")


def _rules(found):
    return C.robots_rules(found.select("domain").distinct().withColumn("text", F.lit(_ROBOTS)))


def crawl_candidates(spark, d):
    """Pages to be crawled: inside the scope, not among every third page (visited), allowed by robots, without a query of utm parameters."""
    f = _found(spark, d)
    visited = f.withColumn("url", F.when(F.pmod("page_id", F.lit(3)) == 0, F.col("url")))
    keep = U.in_scope(F.col("url"), "x", internal_only=False) & U.filter_reason(F.col("url"), blocked_names=["utm_source"]).isNull()
    return C.worth_crawling(f, visited.filter("url is not null"), _rules(f), keep).select("url").distinct()


def skipped_paths(spark, d):
    f = _found(spark, d)
    return C.skipped_paths(f, _rules(f))


def sitemap_places(spark, d):
    """Hosts that begin with m name a sitemap in robots.txt, those with t are given one, the others get the usual two."""
    f = _found(spark, d).select("domain").distinct()
    robots = f.withColumn("text", F.when(F.col("domain").startswith("m"), F.concat(F.lit("Sitemap: https://"), F.col("domain"), F.lit("/s.xml"))).otherwise(F.lit("User-agent: *")))
    given = f.select("domain", F.when(F.col("domain").startswith("t"), F.concat(F.lit("https://"), F.col("domain"), F.lit("/given.xml"))).alias("sitemap")).filter("sitemap is not null")
    return C.discovered_sitemaps(f, robots, given)


def sitemap_indexes(spark, d):
    """A chain of index files: regions to nations, nations to suppliers' sitemaps; the regions are where one begins."""
    n = _t(spark, d, "nation")
    entry = lambda tag, *loc: F.concat(F.lit(f"<{tag}><loc>"), *[c if not isinstance(c, str) else F.lit(c) for c in loc], F.lit(f"</loc></{tag}>"))
    put = lambda root, x: F.concat(F.lit(f"<{root}>"), F.concat_ws("", F.sort_array(F.collect_list(x))), F.lit(f"</{root}>")).alias("xml")
    s = lambda c: F.col(c).cast("string")
    top = n.groupBy("n_regionkey").agg(put("sitemapindex", entry("sitemap", "n", s("n_nationkey")))).select(F.concat(F.lit("r"), s("n_regionkey")).alias("url"), "xml")
    mid = n.select(F.concat(F.lit("n"), s("n_nationkey")).alias("url"), F.concat(F.lit("<sitemapindex>"), entry("sitemap", "s", s("n_nationkey")), entry("sitemap", "r", s("n_regionkey")), entry("sitemap", "absent"), F.lit("</sitemapindex>")).alias("xml"))
    low = _t(spark, d, "supplier").groupBy("s_nationkey").agg(put("urlset", entry("url", "https://h.example/", s("s_suppkey")))).select(F.concat(F.lit("s"), s("s_nationkey")).alias("url"), "xml")
    roots = _t(spark, d, "region").select(F.concat(F.lit("r"), s("r_regionkey")).alias("url"))
    return C.sitemap_closure(top.unionByName(mid).unionByName(low), roots).select("url", "loc")


def pdf_properties(spark, d):
    """Suppliers as documents' raw properties."""
    m = F.create_map(F.lit("/Title"), F.col("s_name"), F.lit("Author"), F.lit("a"), F.lit("/ModDate"), F.lit(None).cast("string"), F.lit("/Pages"), F.col("s_suppkey").cast("string"))
    return _t(spark, d, "supplier").select("s_suppkey", pdf_metadata(m).alias("m")).select("s_suppkey", F.explode("m").alias("name", "value"))


def proxy_addresses(spark, d):
    k = F.col("s_suppkey").cast("string")
    text = F.when(F.pmod("s_suppkey", F.lit(2)) == 0, F.concat(F.lit("socks5://u:p@h"), k, F.lit(":1080"))).otherwise(F.concat(F.lit("h"), k, F.lit(".example:80")))
    p = _t(spark, d, "supplier").select("s_suppkey", J.proxy_parts(text).alias("p"))
    return p.select("s_suppkey", "p.scheme", "p.user", "p.host", "p.port")


def page_kinds(spark, d):
    """Character sets and kinds of raw bytes under several content types."""
    k = F.pmod("page_id", F.lit(4))
    kind = F.when(k == 0, "text/HTML; charset=x").when(k == 1, "application/pdf").when(k == 2, "text/plain")
    raw = F.when(k == 3, F.encode(F.lit("%PDF-1.7"), "UTF-8")).otherwise(F.encode("html", "UTF-8"))
    return _t(spark, d, "pages").select("page_id", charset(raw).alias("charset"), F.coalesce(is_html(kind), F.lit(False)).alias("html"), is_pdf(kind, raw).alias("pdf"))


def request_tokens(spark, d):
    """Customers' pages give tokens, which their next requests carry, with one token that all share."""
    k = F.col("c_custkey").cast("string")
    html = F.concat(F.lit("<form><input type=hidden name=csrf_token value=f"), k, F.lit("></form><meta name=csrf-token content=m"), k, F.lit(">"))
    c = _t(spark, d, "customer")
    stored = c.select(k.alias("url"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, extract("csrf_tokens", html)).alias("tokens"))
    r = S.with_tokens(c.select(k.alias("url"), F.create_map(F.lit("csrf-token"), F.lit("own")).alias("data"), F.create_map(F.lit("A"), F.lit("1")).alias("headers")), stored, {"xsrf_token": "g"})
    return r.select("url", *[F.col("data")[n].alias(a) for n, a in (("csrf-token", "dashed"), ("csrf_token", "form"), ("xsrf_token", "shared"))], F.col("headers")["X-CSRF-Token"].alias("header"), F.size("headers").alias("headers"))


def token_store(spark, d):
    k = F.col("c_custkey").cast("string")
    stored = _t(spark, d, "customer").select(k.alias("url"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.create_map(F.lit("a"), k, F.lit("b"), k)).otherwise(F.create_map(F.lit("a"), k)).alias("tokens"))
    return A.token_stats(stored, {"g": "x"}).withColumn("names", F.array_join("names", ","))


def results_by_host(spark, d):
    """Hosts' results against the whole: the progress of each host."""
    r = _results(spark, d)
    return r.groupBy("host").agg(F.count("*").alias("crawled"), F.count_if("success").alias("successful"), F.sum("n_links").cast("long").alias("links"), F.max("depth").alias("deepest"))


_E = "e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec, CASE WHEN event_id % 6 = 0 THEN 500 ELSE 200 END AS status, (event_id % 31) / 10.0 AS seconds, (event_id % 9)::INT AS depth, event_id % 5 AS n_links, event_id * 100 AS bytes FROM events)"
_F = r"""f AS (SELECT DISTINCT page_id, CASE WHEN u LIKE '%/' AND u NOT LIKE '%//' THEN u[:-2] ELSE u END AS url, regexp_extract(url,'//([^/?#]*)',1) AS domain, regexp_extract(url,'//[^/?#]*([^?#]*)',1) AS path FROM (SELECT page_id, url, regexp_replace(url,'#.*$','') AS u FROM pages))"""
QUERIES = {
    "hash_store_stats": (hash_store_stats, "SELECT count(*) AS hashes, count(DISTINCT doc_id % 3) AS runs, min(doc_id) AS oldest FROM documents"),
    "state_stats": (state_stats, "SELECT count(*) + count(*) FILTER (doc_id % 3 = 0) AS pages, count(*) + count(*) FILTER (doc_id % 12 IN (3, 6, 9)) AS with_etag, 0::BIGINT AS with_last_modified, round((2 * count(*))::DOUBLE / (count(*) + count(*) FILTER (doc_id % 3 = 0)), 2) AS mean_crawls FROM documents"),
    "progress_stats": (progress_stats, f"WITH {_E}, a AS (SELECT count(*) AS crawled, count(*) FILTER (status = 200) AS successful, count(*) FILTER (status = 500) AS failed, sum(n_links)::BIGINT AS links, max(depth) AS deepest, max(sec) - min(sec) AS s FROM e) SELECT crawled, successful, failed, links, deepest, round(s, 3) AS elapsed, round(crawled / s, 9) AS rate, round(successful / crawled, 9) AS success_rate FROM a"),
    "rate_stats": (rate_stats, f"WITH {_E} SELECT user_id, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, round(avg(seconds), 6) AS mean_seconds, round(count(*) FILTER (status >= 400) / count(*), 6) AS error_rate, CASE WHEN user_id % 2 = 0 THEN user_id / 10.0 ELSE 0.1 END::DOUBLE AS delay FROM e GROUP BY user_id"),
    "budget_stats": (budget_stats, f"""WITH {_E}, a AS (SELECT count(*) AS pages, sum(bytes)::BIGINT AS bytes, max(sec) - min(sec) AS s FROM e) SELECT pages, bytes, round(bytes / 1048576, 6) AS mb, round(pages / 10.0, 6)::DOUBLE AS pages_percent, round(bytes / 1048576 / 50, 6) AS bandwidth_percent, round(s / 1e7, 6) AS time_percent,
 CASE WHEN pages >= 1000 THEN 'pages' WHEN bytes / 1048576 >= 5000 THEN 'bandwidth' WHEN s >= 1e9 THEN 'time' END AS exceeded FROM a"""),
    "cache_stats": (cache_stats, "WITH m AS (SELECT max(ts) - INTERVAL 30 DAY AS m FROM events) SELECT count(*) AS entries, count(*) FILTER (ts > m) AS valid, count(*) FILTER (ts <= m) AS expired, sum(event_id)::BIGINT AS bytes FROM events, m"),
    "task_stats": (task_stats, "SELECT count(*) AS tasks, count(*) FILTER (o_orderkey % 4 = 0) AS pending, count(*) FILTER (o_orderkey % 4 = 1) AS running, count(*) FILTER (o_orderkey % 4 = 2) AS done, count(*) FILTER (o_orderkey % 4 = 3) AS failed, count(DISTINCT o_custkey % 7) AS workers, round(count(*) FILTER (o_orderkey % 4 = 2) / count(*), 9) AS share_done FROM orders"),
    "same_content": (same_content, "SELECT url, n - 1 AS others FROM (SELECT doc_id AS url, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1"),
    "events_of_artifacts": (events_of_artifacts, "SELECT l_linestatus AS event_type, o_orderstatus AS status, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"),
    "cache_lookup": (cache_lookup, "SELECT page_id AS url, coalesce(ts > (SELECT max(ts) FROM events) - INTERVAL 60 DAY, false) AS cached FROM pages LEFT JOIN events ON page_id = event_id"),
    "live_cookies": (live_cookies, "SELECT c_custkey FROM customer WHERE (c_custkey % 5 = 0 OR c_custkey >= 40) AND c_custkey % 4 <> 2"),
    "composite_order": (composite_order, r"SELECT page_id, round((-d + 3 * CASE WHEN page_id % 3 > 0 THEN 1 - (page_id % 10) / 10.0 ELSE d END) / 4, 6)::DOUBLE AS priority FROM (SELECT page_id, len(string_split(regexp_extract(url,'//[^/?#]*([^?#]*)',1), '/')) AS d FROM pages)"),
    "crawl_candidates": (crawl_candidates, f"WITH {_F} SELECT DISTINCT url FROM f WHERE url NOT IN (SELECT url FROM f WHERE page_id % 3 = 0) AND path NOT LIKE '/fr/%' AND url NOT LIKE '%utm_source=_%'"),
    "skipped_paths": (skipped_paths, f"WITH {_F} SELECT DISTINCT domain, path FROM f WHERE path LIKE '/fr/%'"),
    "sitemap_places": (sitemap_places, f"WITH {_F}, h AS (SELECT DISTINCT domain FROM f) SELECT domain, 'https://' || domain || CASE WHEN domain LIKE 'm%' THEN '/s.xml' ELSE '/given.xml' END AS sitemap FROM h WHERE domain LIKE 'm%' OR domain LIKE 't%' UNION ALL SELECT domain, 'https://' || domain || unnest(['/sitemap.xml', '/sitemap_index.xml']) FROM h WHERE domain NOT LIKE 'm%' AND domain NOT LIKE 't%'"),
    "sitemap_indexes": (sitemap_indexes, "SELECT 's' || s_nationkey AS url, 'https://h.example/' || s_suppkey AS loc FROM supplier"),
    "pdf_properties": (pdf_properties, "SELECT s_suppkey, unnest(['title', 'author', 'pages']) AS name, unnest([s_name, 'a', s_suppkey::VARCHAR]) AS value FROM supplier"),
    "proxy_addresses": (proxy_addresses, "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'socks5' ELSE 'http' END AS scheme, CASE WHEN s_suppkey % 2 = 0 THEN 'u' END AS user, 'h' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '.example' END AS host, CASE WHEN s_suppkey % 2 = 0 THEN 1080 ELSE 80 END AS port FROM supplier"),
    "page_kinds": (page_kinds, "SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN 'utf-8' END AS charset, page_id % 4 = 0 AS html, page_id % 4 IN (1, 3) AS pdf FROM pages"),
    "request_tokens": (request_tokens, "SELECT c_custkey::VARCHAR AS url, 'own' AS dashed, CASE WHEN c_custkey % 2 = 0 THEN 'f' || c_custkey END AS form, 'g' AS shared, CASE WHEN c_custkey % 2 = 0 THEN 'f' || c_custkey END AS header, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS headers FROM customer"),
    "token_store": (token_store, "SELECT count(*) AS urls, (sum(2 - c_custkey % 2) + 1)::BIGINT AS tokens, 'a,b,g' AS names FROM customer"),
    "results_by_host": (results_by_host, "SELECT regexp_extract(url,'//([^/?#]*)',1) AS host, count(*) AS crawled, count(*) FILTER (page_id % 7 <> 0) AS successful, sum(len(regexp_extract_all(html,'<a href=')))::BIGINT AS links, max(page_id % 4)::INT AS deepest FROM pages GROUP BY 1"),
}
