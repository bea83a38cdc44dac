"""Downloads, schedules, proxies, tasks and edges of a crawl as columns and small tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import cache_key, clean_file_name, path

_TYPES = {"application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "application/zip": ".zip", "text/plain": ".txt", "text/html": ".html", "application/json": ".json", "text/csv": ".csv"}


def download_decision(url: Column, size: Column, blocked: tuple = (".exe", ".bat", ".sh"), allowed: tuple | None = None, most_mb: float = 100.0) -> Column:
    """struct of take and reason."""
    ext = F.coalesce(F.nullif(F.regexp_extract(F.lower(path(url)), "[^/.]([.][^./]+)$", 1), F.lit("")), F.lit(""))
    why = F.when(ext.isin(*blocked), "blocked_extension")
    if allowed is not None:
        why = why.when(~ext.isin(*allowed), "extension_not_allowed")
    why = why.when(size > most_mb * 1024 * 1024, "too_large")
    return F.struct(why.isNull().alias("take"), why.alias("reason"))


def type_extension(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])[kind], F.lit(""))


def download_name(url: Column, disposition: Column, content_type: Column) -> Column:
    """From Content-Disposition, else the URL's last part, else a hash of the URL with the type's extension."""
    named = F.nullif(F.regexp_extract(F.coalesce(disposition, F.lit("")), "filename=[\"']?([^\"';]+)", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(path(url), "([^/]+)$", 1), F.lit(""))
    return clean_file_name(F.coalesce(named, last, F.concat(F.lit("download_"), F.substring(cache_key(url), 1, 8), type_extension(content_type))))


def checksum_matches(data: Column, content_md5: Column) -> Column:
    """True where no checksum is given."""
    return content_md5.isNull() | (F.md5(data) == F.lower(content_md5))


def task_id(url: Column, depth: Column, created: Column) -> Column:
    return F.md5(F.concat_ws(":", url, depth.cast("string"), created.cast("string")))


def task_priority(depth: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(10) - depth)


def next_runs(schedules: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """The next runs of enabled schedules(id, enabled, last_run, every_seconds), the soonest first: due at once without a last run."""
    due = F.coalesce(F.col("last_run") + F.make_interval(secs=F.col("every_seconds")), now)
    return schedules.filter("enabled").select("id", due.alias("next_run")).orderBy("next_run", "id").limit(most)


def scheduled(schedules: DataFrame, add: DataFrame | None = None, remove: tuple = (), enable: tuple = (), disable: tuple = ()) -> DataFrame:
    """schedules(id, enabled, last_run, every_seconds) after changes: rows of `add` take the place of their ids, the named ids go or are switched."""
    d = schedules
    if add is not None:
        d = d.join(add.select("id"), "id", "left_anti").unionByName(add)
    d = d.filter(~F.col("id").isin(*remove)) if remove else d
    on = F.col("enabled")
    on = F.when(F.col("id").isin(*enable), True).otherwise(on) if enable else on
    return d.withColumn("enabled", F.when(F.col("id").isin(*disable), False).otherwise(on) if disable else on)


def _cron_field(text: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
        if not (low <= first <= last <= high) or (step and int(step) < 1):
            raise ValueError(f"bad cron field: {text}")
        out |= set(range(first, last + 1, int(step or 1)))
    return frozenset(out)


def next_cron(expression: str, after: datetime) -> datetime:
    """The first minute after `after` that a cron expression of five fields names; weekdays 0 and 7 are Sunday. ValueError for others."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"bad cron expression: {expression}")
    minutes, hours, days, months = (_cron_field(f, *r) for f, r in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12))))
    week = frozenset(d % 7 for d in _cron_field(fields[4], 0, 7))
    either = fields[2] != "*" and fields[4] != "*"  # then one of the two is enough
    t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 5):
        in_month, in_week = t.day in days, (t.weekday() + 1) % 7 in week
        if t.month in months and ((in_month or in_week) if either else (in_month and in_week)):
            for h in sorted(x for x in hours if x >= t.hour):
                m = min((x for x in minutes if h > t.hour or x >= t.minute), default=None)
                if m is not None:
                    return t.replace(hour=h, minute=m)
        t = t.replace(hour=0, minute=0) + timedelta(days=1)
    raise ValueError(f"no such day: {expression}")


def next_cron_run(expression: Column, after: Column) -> Column:
    """next_cron as a column; null for null and for what isn't an expression."""
    def run(e, a):
        try:
            return None if e is None or a is None else next_cron(e, a)
        except ValueError:
            return None

    return F.udf(run, "timestamp", useArrow=True)(expression, after)


def live_proxies(proxies: DataFrame, now: Column, failures: int = 5, rest_seconds: int = 300) -> DataFrame:
    """proxies(id, requests, failed, failed_in_row, failed_at) that may be used, with success_rate (100 without requests)."""
    ok = (F.col("failed_in_row") < failures) | (F.col("failed_at") + F.make_interval(secs=F.lit(rest_seconds)) <= now)
    return proxies.filter(ok).withColumn("success_rate", F.when(F.col("requests") > 0, (F.col("requests") - F.col("failed")) * 100.0 / F.col("requests")).otherwise(100.0))


def chosen_proxy(proxies: DataFrame, strategy: str = "least_used", seed: int = 0) -> DataFrame:
    """The proxy of fewest requests, of the best rate, or a random one, by a hash of id and seed; the least id among equals."""
    if strategy == "random":
        key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    else:
        key = F.col("requests").cast("double") if strategy == "least_used" else -F.col("success_rate")
    return proxies.agg(F.min_by("id", F.struct(key, "id")).alias("id"))


def proxy_parts(text: Column) -> Column:
    """struct of scheme, user, host and port of scheme://user:password@host:port; http where no scheme is written."""
    return F.struct(F.coalesce(F.nullif(F.lower(F.regexp_extract(text, "^([a-zA-Z0-9]+)://", 1)), F.lit("")), F.lit("http")).alias("scheme"), F.nullif(F.regexp_extract(text, "(?:^|//)([^:@/]+):[^@/]*@", 1), F.lit("")).alias("user"),
                    F.regexp_extract(text, "(?:^|//|@)([^:@/]+)(?::[0-9]+)?/?$", 1).alias("host"), F.regexp_extract(text, ":([0-9]+)/?$", 1).try_cast("int").alias("port"))


def edges(artifacts: DataFrame) -> DataFrame:
    """from_url, to_url, depth, method of artifacts(url, discovered_from, depth, method) that were found on a page; seeds have no edge."""
    return artifacts.filter("discovered_from is not null").select(F.col("discovered_from").alias("from_url"), F.col("url").alias("to_url"), "depth", F.coalesce("method", F.lit("link")).alias("method"))


def languages_present(scores: DataFrame, least: float = 0.05) -> DataFrame:
    """id, languages: all whose share of frequent words is over `least`, the greatest first."""
    kept = scores.filter(F.col("score") > least)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "place", "language")))
    return kept.groupBy("id").agg(F.transform(ordered, lambda x: x["language"]).alias("languages"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """An addition of this engine: runs of a key's events with no gap longer than `gap`."""
    return events.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def report_rows(results: DataFrame, links: int = 5) -> DataFrame:
    """A line of HTML for each result(url, depth, status, success, links), escaped, with its first links."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    some = F.array_join(F.transform(F.slice("links", 1, links), lambda x: F.concat(F.lit("<li>"), esc(x), F.lit("</li>"))), "")
    return results.select("url", F.concat(F.lit("<tr><td>"), esc(F.col("url")), F.lit("</td><td>"), F.col("depth").cast("string"), F.lit("</td><td>"), F.col("status").cast("string"), F.lit("</td><td><ul>"), some, F.lit("</ul></td></tr>")).alias("row"))


