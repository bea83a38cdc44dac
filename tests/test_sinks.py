import glob
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import contracts as K
from weftline.operators import crawl as C
from weftline.operators import security as S
from weftline.sources import fetch as W
from weftline.sources import sinks as K2
from weftline.sources import tables as R
from weftline.streaming import events as E


def read(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture(scope="module")
def results(spark):
    rows = [("https://h/b", 200, 1, "text/html", True, None, ["https://h/x", "https://h/<y>"], "<p>"), ("https://h/a?x=1&y=2", 404, 0, None, False, "gone", None, None)]
    return spark.createDataFrame(rows, "url string, status int, depth int, content_type string, success boolean, error string, links array<string>, html string")


def test_result_files(spark, results, tmp_path):
    for kind in ("json", "CSV", "txt", "html"):
        K2.save_results(results, f"{tmp_path}/{kind}", kind, "today")
    rows = [json.loads(x) for x in read(f"{tmp_path}/json").splitlines()]
    assert {r["url"] for r in rows} == {"https://h/b", "https://h/a?x=1&y=2"} and all("html" not in r and r["timestamp"] == "today" for r in rows)
    back = {r["URL"]: r for r in spark.read.option("header", True).csv(f"{tmp_path}/CSV").collect()}
    assert back["https://h/b"]["Links Found"] == "2" and back["https://h/a?x=1&y=2"]["Content Type"] == "N/A" and len(back["https://h/b"]) == 11
    text = read(f"{tmp_path}/txt")
    assert text.startswith("Crawl Results - Generated at today\nTotal URLs: 2\n===") and text.index("h/a?x") < text.index("h/b") and "Error: gone" in text and "  - https://h/<y>" in text
    page = read(f"{tmp_path}/html")
    assert page.startswith("<!DOCTYPE html>") and page.strip().endswith("</html>") and "2 URLs, 1 successful, 1 failed" in page and "x=1&amp;y=2" in page and "&lt;y&gt;" in page and "<y>" not in page
    with pytest.raises(ValueError):
        K2.save_results(results, f"{tmp_path}/x", "pdf", "")
    with pytest.raises(Exception, match="(?i)exists"):
        K2.save_results(results, f"{tmp_path}/json", "json", "")


def test_jsonl_appends_and_reads_back(spark, results, tmp_path):
    at = f"{tmp_path}/lines"
    R.write_jsonl(results, at)
    R.write_jsonl(results, at, "append")
    back = R.jsonl(spark, at, results._jdf.schema().toDDL())
    assert back.count() == 4 and sorted(map(str, back.distinct().collect())) == sorted(map(str, results.collect()))


def test_table_files(spark, tmp_path):
    t = spark.createDataFrame([("p", [[["a", "b,c"], ['d"e', "f"]], [["x"]]])], "name string, tables array<array<array<string>>>")
    K2.save_tables(t, f"{tmp_path}/c")
    K2.save_tables(t, f"{tmp_path}/j", "json")
    assert read(f"{tmp_path}/c/table=p_1") == 'a,"b,c"\n"d""e",f\n' and read(f"{tmp_path}/c/table=p_2") == "x\n"
    assert json.loads(read(f"{tmp_path}/j/table=p_1")) == {"headers": ["a", "b,c"], "data": [['d"e', "f"]]} and json.loads(read(f"{tmp_path}/j/table=p_2")) == {"headers": ["x"], "data": []}


def test_artifact_store(spark, tmp_path):
    a = spark.createDataFrame([("u1", "<p>", None, 0, "seed", "r"), ("u2", "<p>", "u1", 1, None, "r"), ("u3", None, "u1", 1, "sitemap", "r")], "url string, html string, discovered_from string, depth int, method string, run_id string")
    e = K2.logged_events(a.select("run_id", "url", F.lit("t").alias("at"), (F.col("url") != "u3").alias("success"), F.lit(200).alias("status"), F.lit("x").alias("error"), F.when(F.col("url") == "u2", "u1").alias("duplicate_of")))
    assert sorted((r.event_type, r.url, r.level) for r in e.collect()) == [("duplicate_content", "u2", "INFO"), ("fetch_error", "u3", "ERROR"), ("page_fetched", "u1", "INFO"), ("page_fetched", "u2", "INFO")]
    run = K2.manifest("r", {"b": 1, "a": 2}, "t", ["u1"])
    assert run["config_hash"] == K2.manifest("r", {"a": 2, "b": 1}, "t", [])["config_hash"] and len(run["config_hash"]) == 16
    for _ in range(2):
        K2.save_artifacts(spark, a, e, str(tmp_path), run)
    assert json.loads(read(f"{tmp_path}/run.json")) == run
    assert spark.read.json(f"{tmp_path}/artifacts.jsonl").count() == 6 and "html" not in spark.read.json(f"{tmp_path}/artifacts.jsonl").columns
    assert sorted((r.from_url, r.to_url, r.method) for r in spark.read.json(f"{tmp_path}/edges.jsonl").distinct().collect()) == [("u1", "u2", "link"), ("u1", "u3", "sitemap")]
    assert spark.read.parquet(f"{tmp_path}/blobs").distinct().count() == 1


def test_crawl_row_and_json(spark, results):
    assert tuple(K2.crawl_row(results, 7, "t").first()) == (7, "t", 2, 1, 1)
    assert {json.loads(r.value)["error"] for r in K2.as_json(results).collect()} == {None, "gone"}


def test_contracts(spark):
    with pytest.raises(TypeError):
        K.extracted(F.col("h"), F.col("u"), [K.Extractor("a", len), K.Extractor("a", len)])
    with pytest.raises(TypeError):
        K.piped(spark.range(1), [lambda d: None])
    r = K.Router()
    assert r.route(spark.range(1).withColumn("content_type", F.lit("x"))) is None and r.handler("a/b") is None and not r.unregister("a/b")
    r.register("Text/HTML; a=b", lambda d: d)
    assert r.types() == ["text/html"] and r.handler("TEXT/html;x") is not None and r.unregister("text/html")
    d = spark.createDataFrame([("<p>", "u"), (None, "v")], "h string, u string")
    x = d.select("u", K.extracted(F.col("h"), F.col("u"), [K.Extractor("n", lambda h, u: len(h))]).alias("x")).collect()
    assert {r.u: (r.x.extracted, [e.message for e in r.x.errors]) for r in x} == {"u": ({"n": "3"}, []), "v": ({}, ["TypeError: object of type 'NoneType' has no len()"])}


def test_remarks(spark):
    h = spark.createDataFrame([({"Strict-Transport-Security": "max-age=100", "X-XSS-Protection": "0", "referrer-policy": "unsafe-url", "X-Frame-Options": "ALLOWALL", "x-content-type-options": "x", "content-security-policy": "img-src *"},), ({},)], "h map<string,string>")
    a, b = (r[0] for r in h.select(S.header_remarks(F.col("h"))).collect())
    assert a.issues == ["strict-transport-security: max-age is too short", "content-security-policy: allows any source (*)", "x-frame-options: invalid value", "x-content-type-options: invalid value", "x-xss-protection: is switched off", "referrer-policy: is permissive"]
    assert "strict-transport-security: add includeSubDomains" in a.advice and "permissions-policy: add it" in a.advice and b.issues == [] and len(b.advice) == 10


def test_resume(spark, tmp_path):
    seeds = spark.createDataFrame([("a",)], "url string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a"), ("a", None)], "from_url string, to_url string")
    at = str(tmp_path / "run")
    assert not C.resume_info(spark, at)["can_resume"]
    assert C.crawl(seeds, edges, 1, at).count() == 2 and C.resume_info(spark, at) == {"can_resume": True, "levels": 2, "visited": 2, "frontier": 1}
    more = C.crawl(seeds, edges.filter("from_url <> 'a'"), 9, at)  # a's links are known from the first part
    assert sorted(map(tuple, more.collect())) == [("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, kind string"
    put = lambda n, rows: spark.createDataFrame(rows, "ts string, kind string").select(F.col("ts").cast("timestamp"), "kind").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    put(1, [("2020-01-01 00:10:00", "a"), ("2020-01-01 00:20:00", "a"), ("2020-01-01 05:00:00", "b")])
    put(2, [("2020-01-01 04:40:00", "b")])  # from here on, the first hour is closed
    put(3, [("2020-01-01 00:30:00", "a"), ("2020-01-01 04:30:00", "b")])  # the first is late by more than an hour
    put(4, [("2020-01-02 00:00:00", "c")])
    s = E.file_stream(spark, f"{tmp_path}/in/*", schema, 1)
    out = E.run_once(E.windowed_counts(s, "ts", "kind", "1 hour", "1 hour"))
    assert sorted((str(r.window_start), r.kind, r.n) for r in out.collect()) == [("2020-01-01 00:00:00", "a", 2), ("2020-01-01 04:00:00", "b", 2), ("2020-01-01 05:00:00", "b", 1)]


class _Site(BaseHTTPRequestHandler):
    seen: dict = {}

    def do_GET(self):
        n = _Site.seen[self.path] = _Site.seen.get(self.path, 0) + 1
        page = {"/": b"<a href=/a>a</a><a href=/private/x>x</a>", "/a": b"<a href=/b></a><a href=/></a>", "/b": "<p>\u00fc".encode(), "/robots.txt": b"User-agent: *\nDisallow: /private", "/private/x": b"no"}.get(self.path)
        code = 200 if page is not None else 404
        if self.path == "/busy" and n < 3:
            code, page = (429, b"") if n == 1 else (500, b"")
        elif self.path == "/busy":
            code, page = 200, b"ok"
        self.send_response(code)
        self.send_header("Content-Type", "text/plain" if self.path == "/robots.txt" else "text/html; charset=utf-8")
        if code == 429:
            self.send_header("Retry-After", "7")
        if self.path == "/b":
            self.send_header("Content-MD5", "bad")
        self.end_headers()
        self.wfile.write(page or b"")

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def site():
    s = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetcher(site):
    waits = []
    get = W.HttpFetcher(sleep=waits.append)
    r = get(f"{site}/busy")
    assert (r.success, r.tries, r.text(), waits) == (True, 3, "ok", [7.0, 2.0])
    r = get(f"{site}/none")
    assert (r.success, r.status, r.tries, r.error) == (False, 404, 1, "HTTP 404")
    with pytest.raises(Exception, match="404"):
        r.raise_for_status()
    assert get(f"{site}/b").text() == "<p>\u00fc" and get("ftp://x/y").status == 400 and get("nonsense").status == 400
    waits.clear()
    assert (W.HttpFetcher(retries=2, sleep=waits.append)("http://127.0.0.1:9/x").status, waits) == (503, [1.0, 2.0])
    assert W.HttpFetcher(most_bytes=3)(f"{site}/").status == 413


def test_fetched_tables(spark, site):
    u = spark.createDataFrame([(f"{site}/a",), (f"{site}/b",), (f"{site}/none",)], "url string")
    rows = {r.url.rpartition("/")[2]: r for r in W.fetched(u, W.HttpFetcher(retries=0)).collect()}
    assert (rows["a"].success, rows["a"].content_type, rows["none"].status, rows["none"].body) == (True, "text/html; charset=utf-8", 404, None)
    d = {r.url.rpartition("/")[2]: r for r in W.downloads(u, W.HttpFetcher(retries=0)).collect()}
    assert d["a"].success and not d["b"].success and d["b"].error == "checksum differs" and len(d["a"].sha256) == 64


def test_command_line(spark, site, tmp_path, capsys):
    assert cli.main(["--list"]) == 0 and "page_links" in capsys.readouterr().out
    assert cli.main(["no_such_query", "x"]) == 2
    out = str(tmp_path / "crawl")
    assert cli.main(["--crawl", f"{site}/", "-o", out, "--depth", "2", "--retries", "0"]) == 0
    got = {(r.url.replace(site, ""), r.depth) for p in (0, 1, 2) for r in spark.read.parquet(f"{out}/pages={p}").collect()}
    assert got == {("/", 0), ("/a", 1), ("/b", 2)} or got == {("/", 0), ("/a", 1), ("/b", 2), ("", 2)}
    before = dict(_Site.seen)
    assert cli.main(["--crawl", f"{site}/", "-o", out, "--depth", "2", "--retries", "0"]) == 0
    assert all(before[p] == _Site.seen[p] for p in ("/", "/a", "/b"))  # levels that are there aren't fetched again


def test_queue(spark, tmp_path):
    from weftline.streaming.queues import FileQueue

    q = FileQueue(spark, str(tmp_path), "tasks", "url string, depth int, _priority int")
    assert q.size() == 0
    q.publish(spark.createDataFrame([("a", 0), ("b", 99)], "url string, depth int"), "depth")
    got = []
    q.consume(lambda d, i: got.extend((r.url, r._priority) for r in d.collect()))
    q.publish(spark.createDataFrame([("c", 1)], "url string, depth int"))

    def fail(d, i):
        raise ValueError("not now")

    with pytest.raises(Exception, match="not now"):
        q.consume(fail)
    q.consume(lambda d, i: got.extend((r.url, r._priority) for r in d.collect()))
    assert sorted(got, key=str) == [("a", 0), ("b", 10), ("c", None)] and q.size() == 3
    q.delete()
    assert q.size() == 0


def test_pdf_rows(spark):
    from weftline.sources.pdf import available, pdf_texts

    r = pdf_texts(spark.createDataFrame([("p", b"%PDF-broken"), ("q", None)], "path string, content binary")).collect()
    assert [x.success for x in r] == [False, False] and all(x.error for x in r) and (available() or r[0].error == "no PDF library")


def test_kept_html_and_cache(spark):
    from weftline.operators import state as T

    p = spark.createDataFrame([("u", "<p>"), ("v", None)], "url string, html string")
    assert T.kept_html(p, "memory")[0].columns == ["url", "html"] and T.kept_html(p, "none")[0].columns == ["url"]
    left, stored = T.kept_html(p, "file")
    assert left.join(stored, left.stored == stored.name).select("url", "html").collect() == [("u", "<p>")] and left.columns == ["url", "stored"]
    with pytest.raises(ValueError):
        T.kept_html(p, "tape")
    new = T.with_entries(p, spark.createDataFrame([("v", "<b>"), ("w", "x")], "url string, html string"))
    assert sorted(map(tuple, new.collect())) == [("u", "<p>"), ("v", "<b>"), ("w", "x")]
    assert [r.url for r in T.without_urls(p, new.filter("url <> 'u'")).collect()] == ["u"]


def test_cron_and_patterns():
    from datetime import datetime

    from weftline.functions.urls import checked_patterns, composite
    from weftline.operators.jobs import next_cron

    at = datetime(2024, 2, 28, 23, 59, 30)
    want = {"* * * * *": "02-29 00:00", "5 4 * * *": "02-29 04:05", "0 0 29 2 *": "02-29 00:00", "0 12 * * 1-5": "02-29 12:00", "0 0 * * 7": "03-03 00:00", "*/20 8-9 1 3,5 *": "03-01 08:00", "0 0 13 * 5": "03-01 00:00"}
    assert {e: next_cron(e, at).strftime("%m-%d %H:%M") for e in want} == want
    for bad in ("* * * *", "60 * * * *", "* * * * 8", "0 0 30 2 *", "a * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            next_cron(bad, at)
    assert checked_patterns("a+", "b") == ["a+", "b"]
    for f in (lambda: checked_patterns("("), lambda: composite([])):
        with pytest.raises(ValueError):
            f()
