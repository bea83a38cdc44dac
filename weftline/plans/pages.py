"""Queries of what users plug in and of reports over extracted pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import ship
from weftline.functions import urls as U
from weftline.operators import contracts as K
from weftline.operators import report as R
from weftline.operators.extract import extract, extract_many, keyphrases
from weftline.plans.content import QUERIES as _CONTENT
from weftline.plans.rendered import _many, _page
from weftline.sources.sinks import error_text, with_error, whole
from weftline.sources.tables import table


def _t(spark, d, name):
    ship(spark)
    return table(spark, d, name)


def plugged_extractors(spark, d):
    """Two extractors of a user's: one counts paragraphs, the other fails on every page of a query."""
    def queries(html, url):
        if "?" in url:
            raise ValueError("has a query")
        return None

    x = K.extracted(F.col("html"), F.col("url"), [K.Extractor("paragraphs", lambda h, u: {"p": h.count("<p>")}), K.Extractor("queries", queries)])
    p = _t(spark, d, "pages").select("page_id", x.alias("x"))
    e = F.get(F.col("x.errors"), F.lit(0))
    return p.select("page_id", F.get_json_object(F.col("x.extracted")["paragraphs"], "$.p").cast("int").alias("paragraphs"), F.size("x.extracted").alias("extracted"), e["source"].alias("failed"), e["message"].alias("message"))


def routed_pages(spark, d):
    """Pages by the content types that their ids give them: HTML, JSON, and the rest by default."""
    k = F.pmod("page_id", F.lit(4)).cast("int")
    p = _t(spark, d, "pages").withColumn("content_type", F.get(F.array(F.lit("text/HTML; charset=utf-8"), F.lit("application/json"), F.lit("image/png"), F.lit(None).cast("string")), k))
    named = lambda n: lambda x: x.select("page_id", F.lit(n).alias("handler"))
    r = K.Router().register("text/html", named("html")).register("Application/JSON;x=1", named("json"))
    r.default = named("other")
    return r.route(p)


def piped_pages(spark, d):
    """A pipeline of three stages: pages without a query pass, get a field, and those of long titles go."""
    stages = [lambda x: x.filter(~F.col("url").contains("?")), lambda x: x.withColumn("title", F.regexp_extract("html", "<title>(.*?)</title>", 1)), lambda x: x.filter(F.length("title") < 60)]
    return K.piped(_t(spark, d, "pages"), stages).select("page_id", F.length("title").alias("length"))


def links_of_new_contents(spark, d):
    """Documents as pages: those whose text an earlier one has aren't counted words of."""
    x = K.fresh_pages(_t(spark, d, "documents"), "text", "doc_id", "doc_id")
    return x.select("doc_id", F.size(F.split("text", " ")).alias("words"))


def content_report(spark, d):
    p = _t(spark, d, "pages").select(U.page_type(F.col("url")).alias("page_type"), extract("content", F.col("html"), F.col("url")).alias("content"))
    return R.content_report(p)


def _gallery(spark, d):
    """Parts as pages of as many images and tables as their sizes have tens, at a depth by their number."""
    n = F.floor(F.col("p_size") / 20).cast("int")
    html = F.concat(F.repeat(F.lit("<img src=a.png>"), n), F.repeat(F.lit("<table><tr><td>x</td></tr></table>"), F.floor(F.col("p_size") / 30).cast("int")))
    return _t(spark, d, "part").select("p_partkey", F.pmod("p_partkey", F.lit(3)).cast("int").alias("depth"), extract_many(["images", "tables"], html).alias("x"))


def images_report(spark, d):
    return R.counted_report(_gallery(spark, d), F.size("x.images"))


def tables_report(spark, d):
    return R.counted_report(_gallery(spark, d), F.size("x.tables"))


def keyphrase_report(spark, d):
    """The limit is what the report is for."""
    return R.keyphrase_report(_t(spark, d, "documents").select("doc_id", F.explode(keyphrases(F.col("text"))).alias("phrase")), 20)


def _rendered(spark, d):
    k = F.col("s_suppkey")
    links = F.transform(F.sequence(F.lit(1), F.pmod(k, F.lit(8)) + 1), lambda i: F.concat(F.lit("https://h.example/"), i.cast("string")))
    some = lambda n, c: F.transform(F.sequence(F.lit(1), n), lambda i: c)
    grid = some(F.lit(4), F.array(*[F.lit(x) for x in "abcd"]))
    return _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("https://h.example/s"), k.cast("string")).alias("url"), F.lit(200).alias("status"), F.when(F.pmod(k, F.lit(2)) == 0, 1).alias("depth"), F.lit("text/html").alias("content_type"), (F.pmod(k, F.lit(3)) > 0).alias("success"), F.when(F.pmod(k, F.lit(3)) == 0, "gone").alias("error"),
                                             F.when(F.pmod(k, F.lit(5)) > 0, links).alias("links"), F.array(F.struct(F.lit("i.png").alias("src"), F.lit(None).cast("string").alias("alt"))).alias("images"), F.array(F.lit("k1"), F.lit("k2")).alias("keywords"), F.array(grid, grid).alias("tables"))


def result_texts(spark, d):
    r = _rendered(spark, d)
    w = whole(r)
    return w.select(R.text_entry(*[F.col(c) for c in w.columns]).alias("entry"))


def result_lines(spark, d):
    w = whole(_rendered(spark, d))
    return w.select(*R.csv_row(*[F.col(c) for c in w.columns]))


def typed_items(spark, d):
    """Items of two types and a list of types on each part's page."""
    k = F.col("p_partkey")
    html = _page("<script type='application/ld+json'>[{\"@type\":\"Product\",\"sku\":", k, "},{\"@type\":[\"Thing\",\"Offer\"],\"n\":1}]</script><div itemscope itemtype='https://schema.org/Offer'><b itemprop=price>", F.col("p_size"), "</b></div>")
    s = _many(spark, d, "part", "p_partkey").select("p_partkey", extract("structured", html).alias("s"))
    return s.select("p_partkey", F.get_json_object(F.get(R.by_type(F.col("s"), "Product"), F.lit(0)), "$.sku").cast("long").alias("sku"), F.size(R.by_type(F.col("s"), "Offer")).alias("offers"), R.has_type(F.col("s"), "Thing").alias("thing"), R.has_type(F.col("s"), "Event").alias("event"), F.array_join("s.types", ",").alias("types"))


def form_choice(spark, d):
    k = F.col("s_suppkey")
    f = extract("forms", _page("<form id=a action=/x><input name=q></form><form id=f", k, " action=/y/", k, " method=post><input name=n type=file></form>"), F.lit("https://h.example/"))
    return _many(spark, d, "supplier", "s_suppkey").select("s_suppkey", k.cast("string").alias("k"), f.alias("f")).select("s_suppkey", R.form_by_id(F.col("f"), "a")["action"].alias("a"), R.form_by_id(F.col("f"), "absent")["action"].alias("absent"), F.size(F.filter("f", lambda x: x["action"].contains("/y/"))).alias("posts"), F.col("f")[1]["has_file"].alias("file"))


def failed_artifacts(spark, d):
    """Pages of a query as failed fetches, with the error as text."""
    p = with_error(_t(spark, d, "pages").withColumn("errors", F.lit(None).cast("array<struct<code:string,message:string,source:string,http_status:int>>")), "errors", F.col("url").contains("?"), "FETCH_ERROR", F.concat(F.lit("no "), F.col("page_id").cast("string")), "fetcher", F.lit(500))
    return p.select("page_id", error_text(F.get("errors", F.lit(0))).alias("error"))


QUERIES = {
    "plugged_extractors": (plugged_extractors, "SELECT page_id, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs, 1 AS extracted, CASE WHEN contains(url, '?') THEN 'queries' END AS failed, CASE WHEN contains(url, '?') THEN 'ValueError: has a query' END AS message FROM pages"),
    "routed_pages": (routed_pages, "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'json' ELSE 'other' END AS handler FROM pages"),
    "piped_pages": (piped_pages, "SELECT page_id, length(t)::INT AS length FROM (SELECT page_id, url, regexp_extract(html,'<title>(.*?)</title>',1) AS t FROM pages) WHERE NOT contains(url, '?') AND length(t) < 60"),
    "links_of_new_contents": (links_of_new_contents, "SELECT min(doc_id) AS doc_id, len(string_split(text, ' '))::INT AS words FROM documents WHERE text <> '' GROUP BY text UNION ALL SELECT doc_id, CASE WHEN text IS NULL THEN -1 ELSE 1 END FROM documents WHERE coalesce(text, '') = ''"),
    "content_report": (content_report, r"""WITH t AS (SELECT lower(regexp_extract(url,'//[^/?#]*([^?#]*)',1)) AS p, html FROM pages), k AS (SELECT CASE WHEN regexp_matches(p,'^/$|^/index[.]html$|^/home$') THEN 'home' WHEN regexp_matches(p,'/who-we-are|/company|/about') THEN 'about' WHEN regexp_matches(p,'/get-in-touch|/reach-us|/contact') THEN 'contact'
 WHEN regexp_matches(p,'/shop|/item|/product') THEN 'product' WHEN regexp_matches(p,'/articles|/news|/blog') THEN 'blog' WHEN regexp_matches(p,'/account|/signin|/login') THEN 'login' WHEN regexp_matches(p,'/support|/help|/faq') THEN 'faq' WHEN regexp_matches(p,'/find|/search') THEN 'search' WHEN regexp_matches(p,'/department|/cat|/category') THEN 'category' ELSE 'other' END AS k FROM t)
 SELECT 'page_type' AS part, k AS name, count(*) AS n FROM k GROUP BY k UNION ALL SELECT 'language', regexp_extract(html,'<html lang="([a-z]+)"',1), count(*) FROM pages GROUP BY 2 UNION ALL SELECT 'heading', h, count(*) FROM (SELECT unnest(regexp_extract_all(html, '<(h[1-6])>', 1)) AS h FROM pages) GROUP BY h"""),
    "images_report": (images_report, "SELECT depth, sum(p_size // 20)::BIGINT AS total, count(*) AS pages FROM (SELECT (p_partkey % 3)::INT AS depth, p_size FROM part) WHERE p_size >= 20 GROUP BY ROLLUP (depth)"),
    "tables_report": (tables_report, "SELECT depth, sum(p_size // 30)::BIGINT AS total, count(*) AS pages FROM (SELECT (p_partkey % 3)::INT AS depth, p_size FROM part) WHERE p_size >= 30 GROUP BY ROLLUP (depth)"),
    "keyphrase_report": (keyphrase_report, f"SELECT phrase, len(string_split(phrase, ' '))::INT AS words, count(*) AS pages FROM ({_CONTENT['document_keyphrases'][1]}) GROUP BY phrase ORDER BY words DESC, pages DESC, phrase LIMIT 20"),
    "result_texts": (result_texts, r"""SELECT 'URL: https://h.example/s' || k || chr(10) || 'Status: 200' || chr(10) || 'Depth: ' || CASE WHEN k % 2 = 0 THEN '1' ELSE 'N/A' END || chr(10) || 'Content Type: text/html' || chr(10) || 'Success: ' || CASE WHEN k % 3 > 0 THEN 'True' || chr(10) ELSE 'False' || chr(10) || 'Error: gone' || chr(10) END ||
 'Links Found: ' || n || chr(10) || CASE WHEN n = 0 THEN '' ELSE 'Sample Links:' || chr(10) || array_to_string(list_transform(range(1, least(n, 5) + 1), lambda i: '  - https://h.example/' || i || chr(10)), '') || CASE WHEN n > 5 THEN '  - ... and ' || (n - 5) || ' more' || chr(10) ELSE '' END END ||
 array_to_string(['Images Found: 1', 'Sample Images:', '  - i.png (Alt: No alt text)', 'Keywords Found: 2', 'Top Keywords:', '  - k1', '  - k2', 'Key Phrases Found: 0', 'Tables Found: 2', 'Sample Table Structure:', '  | a | b | c | ...  |', '  | a | b | c | ...  |', '  | a | b | c | ...  |', '  | ... |', '  ... and 1 more tables', ''], chr(10)) AS entry
 FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 8 + 1 END AS n FROM supplier)"""),
    "result_lines": (result_lines, """SELECT 'https://h.example/s' || s_suppkey AS "URL", '200' AS "Status", CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE 'N/A' END AS "Depth", 'text/html' AS "Content Type", CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 8 + 1 END::INT AS "Links Found", s_suppkey % 3 > 0 AS "Success",
 CASE WHEN s_suppkey % 3 = 0 THEN 'gone' ELSE '' END AS "Error", 1 AS "Images Found", 2 AS "Keywords Found", 0 AS "Key Phrases Found", 2 AS "Tables Found" FROM supplier"""),
    "typed_items": (typed_items, "SELECT p_partkey, p_partkey AS sku, 2 AS offers, true AS thing, false AS event, 'Offer,Product,Thing' AS types FROM part"),
    "form_choice": (form_choice, "SELECT s_suppkey, 'https://h.example/x' AS a, CAST(NULL AS VARCHAR) AS absent, 1 AS posts, true AS file FROM supplier"),
    "failed_artifacts": (failed_artifacts, "SELECT page_id, CASE WHEN contains(url, '?') THEN '[FETCH_ERROR] (fetcher) no ' || page_id END AS error FROM pages"),
}
