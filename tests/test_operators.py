"""Edge cases of the column functions and of ordered state."""

from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.operators import crawl as C
from weftline.operators import ordered as O
from weftline.operators import security as S
from weftline.operators import state
from weftline.operators import text as T
from weftline.sources import tables as R


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_page_types(spark):
    d = spark.createDataFrame([("http://h/",), ("http://h/about-us",), ("http://h/shop/blog",), ("http://h/zzz",), (None,)], "u string")
    assert [r.t for r in d.select(U.page_type(F.col("u")).alias("t")).collect()] == ["home", "about", "product", "other", "other"]


def test_relative_urls(spark):
    d = spark.createDataFrame([("../z/?q=1#f", "https://a.b/x/y", "https://a.b/z/?q=1"), ("/", "https://a.b/x", "https://a.b"), ("?p", "https://a.b/x", "https://a.b/x?p"), ("//c.d/e", "https://a.b", "https://c.d/e"),
                               ("a/./b/../c", "https://a.b/x/y", "https://a.b/x/a/c"), ("tel:1", "https://a.b", None), ("", "https://a.b", None)], "h string, b string, w string")
    for r in d.withColumn("g", U.normalized(F.col("h"), F.col("b"))).collect():
        assert r.g == r.w, r


def test_sanitized(spark):
    assert one(spark, U.sanitized(F.lit("https://h/p?Token=a&b=c#f"))) == "https://h/p?Token=REDACTED&b=c#f"
    assert one(spark, U.safe_href(F.lit("  JavaScript:x"))) == "#"


def test_schedule(spark):
    d = spark.createDataFrame([("a", 0.0, 1), ("a", 0.2, 2), ("a", 0.4, 3), ("a", 5.0, 4)], "k string, t double, i int")
    assert [r.start for r in O.scheduled_starts(d, "k", "t", "i", 1.0).orderBy("i").collect()] == [0, 1, 2, 5]


def test_next_delay():
    assert abs(O.next_delay(0.1, 0.1, 429, 1.0, None, [1.0], 1, 1) - 0.3) < 1e-9
    assert O.next_delay(0.1, 0.1, 429, 1.0, 500.0, [1.0], 1, 1) == 60.0
    assert O.next_delay(1.0, 0.1, 200, 0.1, None, [0.1] * 5, 0, 5) == 0.9


def test_header_scores(spark):
    h = F.create_map(F.lit("X-Frame-Options"), F.lit("ALLOW-FROM x"))
    r = one(spark, S.header_report(h))
    assert (r.score, r.most, r.rating, len(r.missing)) == (5, 69, "F", 9)
    c = F.create_map(F.lit("content-security-policy"), F.lit("default-src 'self'; script-src 'unsafe-inline' 'unsafe-eval'"))
    assert one(spark, S.header_report(c)).score == 7


def test_firewalls(spark):
    m = lambda *x: F.create_map(*[F.lit(v) for v in x])
    assert tuple(one(spark, S.firewall(m("CF-RAY", "x", "Server", "cloudflare")))) == ("Cloudflare", 7, 0.7)
    assert tuple(one(spark, S.firewall(m("x-amz-cf-id", "a", "x-amz-cf-pop", "b")))) == ("AWS WAF", 6, 0.6)
    assert one(spark, S.firewall(m("a", "b"))).name is None


def test_robots(spark):
    d = spark.createDataFrame([("h", "User-agent: *\nCrawl-delay: 2\nDisallow: /x # no\nAllow: /\n\nUser-agent: Bot\nDisallow:\n")], "domain string, text string")
    rules = C.robots_rules(d)
    assert C.crawl_delays(rules, "any").first().delay == 2.0
    u = spark.createDataFrame([("h", "/x/1"), ("h", "/y"), ("other", "/x")], "domain string, path string")
    assert {(r.domain, r.path): r.allowed for r in C.robots_allowed(u, rules).collect()} == {("h", "/x/1"): False, ("h", "/y"): True, ("other", "/x"): True}
    assert all(r.allowed for r in C.robots_allowed(u, rules, "bot").collect())


def test_crawl_takes_least_depth_and_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), (None, "z")], "from_url string, to_url string")
    s = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    assert {tuple(r) for r in C.crawl(s, e, 5).collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a")}
    assert C.crawl(s.limit(0), e, 2).count() == 0


def test_recrawl_reason(spark):
    k = "url string, etag string, last_modified string, content_hash string"
    now = spark.createDataFrame([("u", "b", "m", None), ("v", None, None, None), ("w", None, None, "h"), ("x", "a", "n", "h"), ("y", None, "m", "h"), ("z", None, None, "h"), ("f", "a", None, None)], k)
    old = spark.createDataFrame([("u", "a", "m", None, 5), ("v", None, None, None, 5), ("x", "a", "m", "g", 5), ("y", "a", "m", "g", None), ("z", None, None, "g", 1), ("f", "a", None, None, 5)], k + ", last_crawled int")
    want = {"u": (True, "etag_changed"), "v": (True, "no_comparison_data"), "w": (True, "new_url"), "x": (False, "etag_match"), "y": (False, "last_modified_match"), "z": (True, "content_changed"), "f": (False, "etag_match")}
    got = lambda *a: {r.url: (r.crawl, r.reason) for r in state.recrawl_decisions(now, old, *a).collect()}
    assert got() == want
    assert got(F.col("url") == "f", F.lit(3)) == {**want, "z": (True, "expired"), "f": (True, "forced")}


def test_first_seen_ignores_null_hashes(spark):
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "i int, h string")
    assert [(r.i, r.duplicate, r.duplicate_of) for r in O.first_seen(d, F.col("h"), "i", "i").orderBy("i").collect()] == [(1, False, None), (2, True, 1), (3, False, None), (4, False, None)]


def test_keyword_ties_by_first_place(spark):
    d = spark.createDataFrame([(1, "zeta alpha zeta alpha beta one two three four five six seven"), (2, "few words"), (3, None)], "doc_id int, text string")
    assert [r.keyword for r in T.keywords(d, top=3).orderBy("id", "rank").collect()] == ["zeta", "alpha", "beta"]


def test_charset_and_kinds(spark):
    assert one(spark, R.charset(F.lit(bytearray(b'<meta charset="UTF-8">')))) == "utf-8"
    assert one(spark, R.is_html(F.lit("Text/HTML; charset=x"))) is True
    assert one(spark, R.is_pdf(F.lit("x"), F.lit(bytearray(b"%PDF-1")))) is True


def test_blobs_and_lines(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, html string")
    R.write_blobs(d, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1
    R.write_jsonl(d, str(tmp_path / "j"))
    assert R.jsonl(spark, str(tmp_path / "j"), "i int, html string").count() == 3
