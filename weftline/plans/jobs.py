"""Queries of downloads, schedules, proxies, tasks, edges and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import ship
from weftline.functions import urls as U
from weftline.operators import jobs as J
from weftline.operators import text as T
from weftline.plans.content import _SCORES
from weftline.sources.tables import table


def _t(spark, d, name):
    ship(spark)
    return table(spark, d, name)


def downloads(spark, d):
    u = F.concat(F.lit("https://h.example/f/"), F.col("p_partkey").cast("string"), F.get(F.array(*[F.lit(x) for x in (".pdf", ".exe", "", "/")]), F.pmod("p_partkey", F.lit(4)).cast("int")), F.lit("?v=1"))
    p = _t(spark, d, "part").withColumn("u", u)
    r = J.download_decision(F.col("u"), F.col("p_size") * F.lit(5 * 1024 * 1024), most_mb=200)
    name = J.download_name(F.col("u"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.concat(F.lit('attachment; filename="a:'), F.col("p_partkey").cast("string"), F.lit('.txt"'))), F.lit("application/pdf; q"))
    return p.select("p_partkey", r["take"].alias("take"), r["reason"].alias("reason"), name.alias("name"))


def upcoming_runs(spark, d):
    """The five next runs: the limit is what the operator is for."""
    s = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("enabled"), F.col("o_orderdate").cast("timestamp").alias("last_run"), F.lit(86400.0).alias("every_seconds"))
    return J.next_runs(s, F.lit("2030-01-01").cast("timestamp")).select("id", F.date_format("next_run", "yyyy-MM-dd").alias("day"))


def _proxies(spark, d):
    k = F.col("s_suppkey")
    p = _t(spark, d, "supplier").select(k.alias("id"), F.pmod(k * 7, F.lit(50)).alias("requests"), F.pmod(k, F.lit(3)).alias("failed"), F.pmod(k, F.lit(7)).alias("failed_in_row"), F.timestamp_seconds(k).alias("failed_at"))
    return J.live_proxies(p.filter("requests >= failed"), F.timestamp_seconds(F.lit(320)))


def proxy_rates(spark, d):
    return _proxies(spark, d).select("id", F.round("success_rate", 6).alias("success_rate"))


def proxy_choice(spark, d):
    p = _proxies(spark, d)
    one = lambda s: J.chosen_proxy(p, s, 7).withColumn("strategy", F.lit(s))
    return one("least_used").unionByName(one("best")).unionByName(one("random"))


def cron_runs(spark, d):
    """Orders as schedules with one of four expressions; the next run after the order's day."""
    e = F.get(F.array(*[F.lit(x) for x in ("30 2 * * *", "0 */6 * * *", "15 4 1 * *", "0 0 * * 0")]), F.pmod("o_orderkey", F.lit(4)).cast("int"))
    n = J.next_cron_run(e, F.col("o_orderdate").cast("timestamp"))
    return _t(spark, d, "orders").select("o_orderkey", F.date_format(n, "yyyy-MM-dd HH:mm").alias("next_run"))


def changed_schedules(spark, d):
    """Suppliers as schedules: some get another interval, some go, some are switched."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.pmod("s_suppkey", F.lit(2)) == 0).alias("enabled"), F.lit(None).cast("timestamp").alias("last_run"), F.lit(60.0).alias("every_seconds"))
    add = s.withColumn("id", F.when(F.pmod("id", F.lit(5)) == 0, F.col("id")).otherwise(F.col("id") + 1_000_000)).withColumn("every_seconds", F.lit(5.0))
    return J.scheduled(s, add, remove=(1, 5), enable=(3,), disable=(4,)).select("id", "enabled", "every_seconds")


def budget_of_time(spark, d):
    """A user's events within 40 days of the first."""
    from weftline.operators.ordered import within_budget

    e = _t(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return within_budget(e, "user_id", ["t", "event_id"], "event_id", max_seconds=40 * 86400.0, at="t").select("event_id")


def crawl_tasks(spark, d):
    p = _t(spark, d, "pages").select("page_id", U.normalized(F.col("url")).alias("url"), F.pmod("page_id", F.lit(13)).cast("int").alias("depth"))
    return p.select("page_id", J.task_id(F.col("url"), F.col("depth"), F.lit("t")).alias("task"), J.task_priority(F.col("depth")).alias("priority"))


def edge_rows(spark, d):
    p = _t(spark, d, "pages").select("url", F.when(F.pmod("page_id", F.lit(5)) > 0, U.netloc(F.col("url"))).alias("discovered_from"), F.pmod("page_id", F.lit(3)).cast("int").alias("depth"), F.when(F.pmod("page_id", F.lit(2)) == 0, F.lit("sitemap")).alias("method"))
    return J.edges(p)


def report_rows(spark, d):
    p = _t(spark, d, "pages").select("url", F.lit(1).alias("depth"), F.lit(200).alias("status"), F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1).alias("links"))
    return J.report_rows(p.select(F.concat("url", F.lit("&x=<1>")).alias("url"), "depth", "status", F.filter("links", lambda x: x.rlike("^/[a-z]+$")).alias("links")), 2)


def mixed_languages(spark, d):
    return J.languages_present(T.word_language_scores(_t(spark, d, "documents"))).select(F.col("id").alias("doc_id"), F.array_join("languages", ",").alias("languages"))


def user_sessions(spark, d):
    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.sessions(e, "user_id", "ts", "12 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


_PX = "p AS (SELECT s_suppkey AS id, (s_suppkey*7) % 50 AS requests, s_suppkey % 3 AS failed, s_suppkey % 7 AS fr FROM supplier), l AS (SELECT id, requests, CASE WHEN requests > 0 THEN (requests - failed) * 100.0 / requests ELSE 100.0 END AS rate FROM p WHERE requests >= failed AND (fr < 5 OR id + 300 <= 320))"
QUERIES = {
    "downloads": (downloads, """SELECT p_partkey, reason IS NULL AS take, reason, CASE WHEN p_partkey % 3 = 0 THEN 'a_' || p_partkey || '.txt' WHEN k = 3 THEN 'download_' || substr(md5('https://h.example/f/' || p_partkey || '/?v=1'),1,8) || '.pdf' ELSE p_partkey || CASE k WHEN 0 THEN '.pdf' WHEN 1 THEN '.exe' ELSE '' END END AS name
 FROM (SELECT p_partkey, p_partkey % 4 AS k, CASE WHEN p_partkey % 4 = 1 THEN 'blocked_extension' WHEN p_size * 5 > 200 THEN 'too_large' END AS reason FROM part)"""),
    "upcoming_runs": (upcoming_runs, "SELECT o_orderkey AS id, strftime(o_orderdate::TIMESTAMP + INTERVAL 1 DAY, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 5"),
    "proxy_rates": (proxy_rates, f"WITH {_PX} SELECT id, round(rate, 6)::DOUBLE AS success_rate FROM l"),
    "proxy_choice": (proxy_choice, f"WITH {_PX} (SELECT id, 'least_used' AS strategy FROM l ORDER BY requests, id LIMIT 1) UNION ALL (SELECT id, 'best' FROM l ORDER BY rate DESC, id LIMIT 1) UNION ALL (SELECT id, 'random' FROM l ORDER BY md5(id || ':7'), id LIMIT 1)"),
    "cron_runs": (cron_runs, """SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN d + INTERVAL 150 MINUTE WHEN 1 THEN d + INTERVAL 6 HOUR WHEN 2 THEN CASE WHEN day(d) = 1 THEN d ELSE date_trunc('month', d) + INTERVAL 1 MONTH END + INTERVAL 255 MINUTE ELSE d + INTERVAL 1 DAY * (7 - dayofweek(d)) END, '%Y-%m-%d %H:%M') AS next_run
 FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS d FROM orders)"""),
    "changed_schedules": (changed_schedules, "SELECT id, CASE id WHEN 3 THEN true WHEN 4 THEN false ELSE e END AS enabled, s::DOUBLE AS every_seconds FROM (SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS e, CASE WHEN s_suppkey % 5 = 0 THEN 5.0 ELSE 60.0 END AS s FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_suppkey % 2 = 0, 5.0 FROM supplier WHERE s_suppkey % 5 > 0) WHERE id NOT IN (1, 5)"),
    "budget_of_time": (budget_of_time, "SELECT event_id FROM (SELECT event_id, epoch_us(ts) / 1e6 AS t, min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS f FROM events) WHERE t - f < 40 * 86400"),
    "crawl_tasks": (crawl_tasks, """SELECT page_id, md5(CASE WHEN u LIKE '%/' AND u NOT LIKE '%//' THEN u[:-2] ELSE u END || ':' || (page_id % 13) || ':t') AS task, greatest(0, 10 - page_id % 13)::INT AS priority FROM (SELECT page_id, regexp_replace(url,'#.*$','') AS u FROM pages)"""),
    "edge_rows": (edge_rows, "SELECT regexp_extract(url,'//([^/?#]*)',1) AS from_url, url AS to_url, (page_id % 3)::INT AS depth, CASE WHEN page_id % 2 = 0 THEN 'sitemap' ELSE 'link' END AS method FROM pages WHERE page_id % 5 > 0"),
    "report_rows": (report_rows, r"""SELECT url || '&x=<1>' AS url, '<tr><td>' || replace(url,'&','&amp;') || '&amp;x=&lt;1&gt;</td><td>1</td><td>200</td><td><ul>' || array_to_string(list_transform(list_filter(regexp_extract_all(html,'<a href="([^"]*)"',1), lambda x: regexp_matches(x,'^/[a-z]+$'))[1:2], lambda x: '<li>' || x || '</li>'), '') || '</ul></td></tr>' AS row FROM pages"""),
    "mixed_languages": (mixed_languages, rf"""WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')), ' ') AS w FROM documents), s AS (SELECT doc_id, len(w) AS n, unnest([{_SCORES}]) AS s FROM d WHERE len(w) >= 20)
 SELECT doc_id, string_agg(s.language, ',' ORDER BY s.hits DESC, s.place DESC) AS languages FROM s WHERE s.hits / n > 0.05 GROUP BY doc_id"""),
    "user_sessions": (user_sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
 n AS (SELECT user_id, k, count(*) AS n FROM k GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id"""),
}
