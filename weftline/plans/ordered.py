"""Queries of ordered and keyed state, over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import ship
from weftline.operators import ordered as O
from weftline.operators import security as S
from weftline.sources.tables import table
from weftline.streaming import events as E


def _events(spark, d):
    ship(spark)
    e = table(spark, d, "events")
    return e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))


def scheduled_starts(spark, d):
    return O.scheduled_starts(_events(spark, d), "user_id", "t", "event_id", 3600.0).select("event_id", F.round("start", 3).alias("start"))


def request_waits(spark, d):
    return O.must_wait(_events(spark, d), "user_id", "t", "event_id", 3600.0).select("event_id", F.round("wait", 3).alias("wait"))


def rolling_response(spark, d):
    return O.rolling_mean(_events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("rolling", 6).alias("rolling"))


def budget_prefix(spark, d):
    return O.within_budget(_events(spark, d), "user_id", ["ts", "event_id"], "event_id", max_items=25, max_size=200_000).select("event_id", "user_id")


def proxy_rotation(spark, d):
    return O.rotated(_events(spark, d), "user_id", ["event_id"], 7).select("event_id", "slot")


def _responses(spark, d):
    k = F.pmod("event_id", F.lit(17))
    return _events(spark, d).select("user_id", "event_id", F.when(k == 3, 429).when(k == 5, 503).otherwise(200).alias("status"), (F.pmod(F.col("event_id") * 7, F.lit(31)) / 8.0).alias("seconds"),
                                    F.when(F.pmod("event_id", F.lit(34)) == 3, F.lit(4.0)).alias("retry_after"))


def adapted_delays(spark, d):
    return O.adapted_delays(_responses(spark, d), "user_id", "event_id").select("event_id", F.round("delay", 6).alias("delay"))


def retry_decisions(spark, d):
    kinds = ["timeout", "connection", "redirects", "http", "request", "other"]
    e = _events(spark, d).select("event_id", F.get(F.array(*[F.lit(k) for k in kinds]), F.pmod("event_id", F.lit(6)).cast("int")).alias("kind"), F.when(F.pmod("event_id", F.lit(4)) == 1, 404).otherwise(502).alias("status"), F.pmod("event_id", F.lit(5)).cast("int").alias("tries"))
    r = e.withColumn("r", S.retry(F.col("kind"), F.col("status"), F.col("tries")))
    return r.select("event_id", F.col("r.status").alias("status"), F.col("r.again").alias("again"), S.wait_before_retry(F.col("status"), F.col("tries"), F.lit(None).cast("int")).alias("wait"))


def stream_counts(spark, d):
    """Complete days of events by type as a stream over the files: a day is given out, and its state dropped, once events are 60 days past it."""
    schema = table(spark, d, "events").schema
    s = E.file_stream(spark, f"{d}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = E.run_once(E.windowed_counts(s, "ts", "event_type", "1 day", "60 days"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_delays(spark, d):
    """The adapting delay as a stream with state; equals adapted_delays where a key's responses come in order."""
    schema = table(spark, d, "events").schema
    s = E.file_stream(spark, f"{d}/events*.parquet", schema)
    k = F.pmod("event_id", F.lit(17))
    r = s.select("user_id", F.col("event_id").cast("long").alias("order"), F.when(k == 3, 429).when(k == 5, 503).otherwise(200).alias("status"), (F.pmod(F.col("event_id") * 7, F.lit(31)) / 8.0).alias("seconds"), F.when(F.pmod("event_id", F.lit(34)) == 3, F.lit(4.0)).alias("retry_after"))
    ship(spark)
    return E.run_once(E.adapting_delays(r, "user_id")).select(F.col("order").alias("event_id"), F.round("delay", 6).alias("delay"))


_DELAYS = """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_id % 17 WHEN 3 THEN 429 WHEN 5 THEN 503 ELSE 200 END AS status, ((event_id * 7) % 31) / 8.0 AS seconds, CASE WHEN event_id % 34 = 3 THEN 4.0 END AS after FROM events),
 r AS (SELECT *, row_number() OVER w AS i, avg(seconds) OVER l AS mean, count(*) OVER l AS recent, count(*) FILTER (status >= 400) OVER (w ROWS UNBOUNDED PRECEDING) AS errors FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id), l AS (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING)),
 s AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS i, 0.1::DOUBLE AS delay FROM e GROUP BY user_id UNION ALL SELECT r.user_id, r.event_id, r.i, CASE WHEN r.status = 429 THEN least(60.0, coalesce(nullif(r.after, 0), greatest(s.delay * 1.5 * 2, 0.1)))
 WHEN r.status >= 500 OR r.i >= 10 AND r.errors / r.i > 0.1 THEN least(60.0, s.delay * 1.5) WHEN r.recent >= 5 AND r.mean > 2.0 THEN least(60.0, s.delay * 1.2) WHEN r.recent >= 5 AND r.mean < 0.5 THEN greatest(0.1, s.delay * 0.9) ELSE s.delay END
 FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1) SELECT event_id, round(delay, 6) AS delay FROM s WHERE i > 0"""
_T = "SELECT *, epoch_us(ts) / 1e6 AS t FROM events"
QUERIES = {
    "scheduled_starts": (scheduled_starts, f"WITH e AS (SELECT event_id, user_id, t, row_number() OVER w - 1 AS i FROM ({_T}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, round(max(t - i*3600.0) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i*3600.0, 3) AS start FROM e"),
    "request_waits": (request_waits, f"SELECT event_id, round(greatest(0.0, coalesce(3600.0 - (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)), 0.0)), 3) AS wait FROM ({_T})"),
    "rolling_response": (rolling_response, "SELECT event_id, round(CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END, 6) AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)"),
    "budget_prefix": (budget_prefix, "SELECT event_id, user_id FROM (SELECT event_id, user_id, count(*) OVER w AS n, coalesce(sum(event_id) OVER w, 0) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n < 25 AND s < 200000"),
    "proxy_rotation": (proxy_rotation, "SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 7)::INT AS slot FROM events"),
    "adapted_delays": (adapted_delays, _DELAYS),
    "retry_decisions": (retry_decisions, """SELECT event_id, CASE k WHEN 0 THEN 408 WHEN 1 THEN 503 WHEN 2 THEN 310 WHEN 3 THEN s ELSE 500 END AS status, (CASE k WHEN 2 THEN false WHEN 3 THEN s >= 500 ELSE true END) AND tries < 3 AS again, least(pow(2.0, tries), 32.0) AS wait
 FROM (SELECT event_id, event_id % 6 AS k, CASE WHEN event_id % 4 = 1 THEN 404 ELSE 502 END AS s, event_id % 5 AS tries FROM events)"""),
    "stream_counts": (stream_counts, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 60 DAY GROUP BY ALL"),
    "stream_delays": (stream_delays, _DELAYS),
}
