"""Fetching over HTTP as an operation on a table of URLs: tasks take the place of threads, coroutines and workers.

fetched() hands each task's rows to a fetcher: any function of (url, headers) that returns a Response. The one given here uses the
standard library, asks again as the engine's retry rules say, and never raises: what goes wrong is a row.
"""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import ship
from weftline.errors import FetchError

SCHEMA = "url string, success boolean, status int, headers map<string,string>, content_type string, body binary, error string, tries int, elapsed_ms double"


@dataclass
class Response:
    url: str
    success: bool
    status: int = 0
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes | None = None
    error: str | None = None
    tries: int = 1
    elapsed_ms: float = 0.0

    @property
    def content_type(self) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == "content-type"), None)

    def text(self) -> str:
        kind = self.content_type or ""
        name = kind.rpartition("charset=")[2].strip("\"' ") if "charset=" in kind else "utf-8"
        try:
            return (self.body or b"").decode(name, "replace")
        except LookupError:
            return (self.body or b"").decode("utf-8", "replace")

    def raise_for_status(self) -> None:
        if not self.success:
            raise FetchError(f"{self.url}: {self.error or self.status}")


def wait(status: int, tries: int, retry_after: str | None) -> float:
    """Seconds before another try: what a 429 asks for, up to 120, else two to the number of tries, up to 32."""
    if status == 429 and retry_after and retry_after.strip().isdigit():
        return min(float(retry_after), 120.0)
    return min(2.0 ** tries, 32.0)


@dataclass
class HttpFetcher:
    """GET; 200 is success. 429, 5xx and faults of the network are tried again, up to `retries` times."""

    user_agent: str = "weftline/1"
    timeout: float = 10.0
    retries: int = 3
    most_bytes: int | None = None
    proxy: str | None = None
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, url: str, headers: dict[str, str] | None = None) -> Response:
        began = time.monotonic()
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({"http": self.proxy, "https": self.proxy} if self.proxy else {}))
        for n in range(self.retries + 1):
            r = self._once(opener, url, headers or {})
            r.tries, r.elapsed_ms = n + 1, (time.monotonic() - began) * 1000
            again = r.status == 429 or r.status >= 500 or r.status == 408
            if r.success or not again or n == self.retries:
                return r
            self.sleep(wait(r.status, n, r.headers.get("Retry-After")))
        return r

    def _once(self, opener, url: str, headers: dict[str, str]) -> Response:
        try:
            q = urllib.request.Request(url, headers={"User-Agent": self.user_agent} | headers)
            if q.type not in ("http", "https"):
                return Response(url, False, 400, error=f"not an http URL: {url}")
            with opener.open(q, timeout=self.timeout) as x:
                body = x.read() if self.most_bytes is None else x.read(self.most_bytes + 1)
                if self.most_bytes is not None and len(body) > self.most_bytes:
                    return Response(url, False, 413, dict(x.headers), None, f"more than {self.most_bytes} bytes")
                return Response(x.url, x.status == 200, x.status, dict(x.headers), body, None if x.status == 200 else f"HTTP {x.status}")
        except urllib.error.HTTPError as e:
            return Response(url, False, e.code, dict(e.headers or {}), None, f"HTTP {e.code}")
        except TimeoutError as e:
            return Response(url, False, 408, error=f"timeout: {e}")
        except (urllib.error.URLError, OSError) as e:
            return Response(url, False, 408 if isinstance(getattr(e, "reason", None), TimeoutError) else 503, error=f"connection: {e}")
        except ValueError as e:
            return Response(url, False, 400, error=f"request: {e}")


def fetched(urls: DataFrame, fetcher: Callable[..., Response] | None = None, headers: str | None = None, by: Column | None = None, parts: int | None = None) -> DataFrame:
    """A row of SCHEMA for each of urls(url and, if named, a column of headers). by: rows of one value (a host) are fetched one after another by one task, so that a rate can be kept."""
    ship(urls.sparkSession)
    get = fetcher or HttpFetcher()
    d = urls.select(F.col("url"), (F.col(headers) if headers else F.lit(None).cast("map<string,string>")).alias("_headers"), (by if by is not None else F.xxhash64("url")).alias("_by"))
    d = d.repartition(parts, "_by") if parts else d.repartition("_by")

    def run(batches: Iterator[pa.RecordBatch]):
        for r in batches:
            out = [get(u, dict(h) if h else None) for u, h in zip(r.column("url").to_pylist(), r.column("_headers").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                r.column("url"), pa.array([x.success for x in out], pa.bool_()), pa.array([x.status for x in out], pa.int32()), pa.array([list(x.headers.items()) for x in out], pa.map_(pa.string(), pa.string())), pa.array([x.content_type for x in out], pa.string()),
                pa.array([x.body for x in out], pa.binary()), pa.array([x.error for x in out], pa.string()), pa.array([x.tries for x in out], pa.int32()), pa.array([x.elapsed_ms for x in out], pa.float64())],
                names=["url", "success", "status", "headers", "content_type", "body", "error", "tries", "elapsed_ms"])

    return d.mapInArrow(run, SCHEMA)


def downloads(urls: DataFrame, fetcher: Callable[..., Response] | None = None) -> DataFrame:
    """fetched() with sha256 and whether the body has the MD5 that Content-MD5 names (in hexadecimal; true without one). What doesn't match is no success."""
    f = fetched(urls, fetcher)
    md5 = F.map_values(F.map_filter("headers", lambda k, _: F.lower(k) == "content-md5"))
    ok = F.coalesce(F.md5("body") == F.lower(F.get(md5, F.lit(0))), F.lit(True))
    return f.withColumn("sha256", F.sha2("body", 256)).withColumn("success", F.col("success") & ok).withColumn("error", F.when(~ok, "checksum differs").otherwise(F.col("error")))


def robots_texts(domains: DataFrame, fetcher: Callable[..., Response] | None = None, scheme: str = "https") -> DataFrame:
    """domain, text of each distinct domain's robots.txt, fetched once; no text where there is none."""
    u = domains.select("domain").distinct().withColumn("url", F.concat(F.lit(f"{scheme}://"), "domain", F.lit("/robots.txt")))
    f = fetched(u, fetcher).filter("success").select("url", F.decode("body", "UTF-8").alias("text"))
    return u.join(f, "url", "left").select("domain", "text")


def spider(seeds: DataFrame, max_depth: int, keep: Callable[[DataFrame], DataFrame], folder: str, fetcher: Callable[..., Response] | None = None, host: Callable[[Column], Column] | None = None) -> DataFrame:
    """A crawl over the network: each level is fetched by all executors, written to the (shared) folder, and gives the next level's links.

    keep: what a frontier (url, depth, discovered_from) is filtered by: scope, robots, budgets, priority with a capacity. A level that is
    already in the folder isn't fetched again, so that a broken crawl goes on where it stopped. Returns the rows of all levels.
    """
    from weftline.operators.crawl import _exists
    from weftline.operators.extract import extract

    spark = seeds.sparkSession
    row = SCHEMA + ", depth int, discovered_from string"
    level = keep(seeds.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("discovered_from")).filter("url is not null").distinct())
    seen, at = None, ""
    for depth in range(max_depth + 1):
        at = f"{folder}/pages={depth}"
        if not _exists(spark, f"{at}/_SUCCESS"):
            got = fetched(level, fetcher, by=host(F.col("url")) if host else None)
            got.join(level, "url").select(*[c.split()[0] for c in row.split(", ")]).write.mode("overwrite").parquet(at)
        pages = spark.read.schema(row).parquet(at)
        seen = pages if seen is None else seen.unionByName(pages)
        links = pages.filter("success and content_type like 'text/html%'").select(F.col("url").alias("discovered_from"), F.explode(extract("links", F.decode("body", "UTF-8"), F.col("url"))).alias("url"))
        level = keep(links.groupBy("url").agg(F.min("discovered_from").alias("discovered_from")).join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth + 1).alias("depth"), "discovered_from"))
    return seen
