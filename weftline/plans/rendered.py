"""Extraction queries whose pages are rendered here from the relational tables, so that SQL on those tables gives what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import ship
from weftline.operators import extract as X
from weftline.operators import security as S
from weftline.operators.extract import extract
from weftline.sources.tables import spread, table


def _t(spark, d, name):
    ship(spark)
    return table(spark, d, name)


def _many(spark, d, name, key):
    """A table whose rows become pages, over all cores."""
    return spread(_t(spark, d, name), key)


def _page(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: A page shows the customers of so many keys, so that pages don't grow with the table.
_KEYS = 1000


def html_tables(spark, d):
    """Each nation's customers as tables, one for each thousand keys, read back as records."""
    row = _page("<tr><td>", F.col("c_custkey"), "</td><td> ", F.col("c_name"), "&nbsp;[1]</td></tr>")
    c = _t(spark, d, "customer").select("c_nationkey", F.floor(F.col("c_custkey") / _KEYS).alias("k"), row.alias("row"))
    p = spread(c, "c_nationkey", "k").groupBy("c_nationkey", "k").agg(F.concat_ws("", F.sort_array(F.collect_list("row"))).alias("r")).select("c_nationkey", _page("<div><table><thead><tr><th>Cust Key</th><th>Name (full)</th></tr></thead>", F.col("r"), "</table></div>").alias("html"))
    t = p.select("c_nationkey", F.explode(X.kept_tables(extract("tables", F.col("html")))).alias("t")).select("c_nationkey", X.table_names(F.col("t")).alias("names"), F.explode(F.slice("t", 2, F.size("t"))).alias("r"))
    return t.select("c_nationkey", F.map_from_arrays("names", "r").alias("m")).select("c_nationkey", F.col("m")["cust_key"].cast("long").alias("cust_key"), F.col("m")["name_full"].alias("name"))


def table_report(spark, d):
    row = _page("<tr><td>", F.col("n_name"), "</td><td colspan=2>x</td></tr>")
    p = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.concat_ws("", F.sort_array(F.collect_list(row))).alias("r"), F.count("*").alias("n"))
    t = p.select("n_regionkey", extract("tables", _page("<table>", F.col("r"), "</table>")).alias("t"))
    return t.select("n_regionkey", F.size(F.col("t")[0]).alias("rows"), F.size(F.col("t")[0][0]).alias("columns"), F.array_join(F.transform(F.col("t")[0], lambda r: r[0]), "|").alias("names"))


def page_meta(spark, d):
    """Every field of a page's content, each page without one of them in turn."""
    k, n = F.col("p_partkey"), 8
    without = lambda i, *parts: F.when(F.pmod(k, F.lit(n)) == i, F.lit("")).otherwise(_page(*parts))
    html = F.concat(F.lit("<html lang=pt-BR><head>"), without(0, "<title> P ", k, " </title>"), without(1, "<meta name=Description content='about ", k, "'>"), without(2, "<meta name=keywords content='a, b ,c", k, "'>"), without(3, "<link rel='x canonical' href=/c/", k, ">"),
                    without(4, "<meta http-equiv=Last-Modified content=m", k, ">"), F.lit("</head><body>"), without(5, "<h1>one</h1><h2> two <b>", k, "</b></h2>"), without(6, "<h6>six</h6>"), F.lit("<time itemprop=dateModified datetime=2020-01-01>x</time><h2>last</h2></body></html>"))
    c = F.col("c")
    p = _many(spark, d, "part", "p_partkey").select("p_partkey", extract("content", html, F.lit("https://h/")).alias("c"))
    return p.select("p_partkey", c["title"].alias("title"), c["description"].alias("description"), F.array_join(c["keywords"], "|").alias("keywords"), c["canonical"].alias("canonical"), c["language"].alias("language"), c["last_modified"].alias("last_modified"),
                    F.array_join(F.transform(c["headings"], lambda h: F.concat(h["level"].cast("string"), h["text"])), "|").alias("headings"))


def spanned_tables(spark, d):
    """Cells over several rows and columns, in tables within tables and with footnotes."""
    k = F.col("n_nationkey")
    html = _page("<table><tr><th rowspan=2>A", k, "</th><th colspan=2>B</th></tr><tr><td>c[1]</td><td>d&nbsp;e</td></tr><tr><td colspan=3>", F.col("n_name"), "</td></tr><tr></tr><tr><td></td><td></td></tr></table><table><tr><td>x<table><tr><td>inner</td></tr></table></td></tr></table>")
    t = _t(spark, d, "nation").select("n_nationkey", extract("tables", html).alias("t"))
    rows = lambda t: F.array_join(F.transform(t, lambda r: F.array_join(r, ",")), ";")
    return t.select("n_nationkey", F.size("t").alias("tables"), rows(F.col("t")[0]).alias("first"), rows(F.col("t")[1]).alias("second"))


_VALUES = [("strict-transport-security", v, s) for v, s in (("max-age=31536000; includeSubDomains; preload", 10), ("max-age=15768000", 3), ("MAX-AGE=10; preload", 3), ("includeSubDomains", 3), ("preload; max-age=31536000", 7))]
_VALUES += [("content-security-policy", v, s) for v, s in (("default-src 'self'; script-src 'self'", 15), ("script-src 'unsafe-inline'", 10), ("script-src 'unsafe-eval'", 12), ("img-src *", 12), ("img-src * ; script-src 'UNSAFE-INLINE' 'unsafe-eval'", 4))]
_VALUES += [("x-frame-options", v, s) for v, s in (("deny", 8), ("SameOrigin", 8), ("allow-from x", 5), ("maybe", 0))] + [("x-content-type-options", "NoSniff", 5), ("x-content-type-options", "sniff", 0), ("x-xss-protection", "1; mode=block", 3), ("x-xss-protection", "1", 2), ("x-xss-protection", "0", 0)]
_VALUES += [("referrer-policy", v, s) for v, s in (("no-referrer", 5), ("strict-origin", 5), ("origin", 3), ("unsafe-url", 1))] + [(n, "x", s) for n, s in (("permissions-policy", 8), ("cross-origin-opener-policy", 5), ("cross-origin-resource-policy", 5), ("cross-origin-embedder-policy", 5))]


def header_values(spark, d):
    """The score of every kind of value of every header, alone."""
    k = F.pmod("c_custkey", F.lit(len(_VALUES))).cast("int")
    one = lambda i: F.get(F.array(*[F.lit(v[i]) for v in _VALUES]), k)
    r = S.header_report(F.create_map(one(0), one(1)))
    return _t(spark, d, "customer").select("c_custkey", one(0).alias("header"), r["score"].alias("score"), F.size(r["missing"]).alias("missing"), r["rating"].alias("rating"))


def page_images(spark, d):
    p = _many(spark, d, "part", "p_partkey").select("p_partkey", _page("<div><img src='/img/", F.col("p_partkey"), ".png' alt='", F.when(F.pmod("p_partkey", F.lit(3)) > 0, F.col("p_name")).otherwise(""), "' width=", F.col("p_size"), " height=abc><iframe><img src=x></iframe><img src=' '><img class='inline-icon' src=/i.png width=8></div>").alias("html"))
    i = p.select("p_partkey", F.explode(extract("images", F.col("html"))).alias("i"))
    return i.select("p_partkey", F.col("i.src").alias("src"), F.col("i.width_int").alias("width"), F.col("i.height_int").alias("height"), F.col("i.decorative").alias("decorative"), F.col("i.parent_tag").alias("parent"))


def page_forms(spark, d):
    k = F.col("s_suppkey")
    login = _page("<form id='f", k, "' method=post action='/login?s=", k, "'><label for=u>User</label><input id=u name=user value='", F.col("s_name"), "' maxlength=20 required><input type=password name=pw><input type=hidden name=csrf_token value='t", k, "'><input type=submit value=Go></form>")
    search = F.when(F.pmod(k, F.lit(2)) == 0, F.lit("<form action=/find><input name=q><select name=s><option value=a>A<option value=b selected>B</select></form>")).otherwise(F.lit(""))
    f = _many(spark, d, "supplier", "s_suppkey").select("s_suppkey", extract("forms", F.concat(login, search), F.lit("https://h.example/x")).alias("f"))
    a = F.col("f")[0]
    return f.select("s_suppkey", F.size("f").alias("forms"), a["action"].alias("action"), a["method"].alias("method"), a["has_csrf"].alias("csrf"), F.size(a["fields"]).alias("fields"), a["fields"][0]["value"].alias("user"), a["fields"][0]["label"].alias("label"),
                    a["fields"][0]["maxlength"].alias("maxlength"), a["submit_text"].alias("submit"), F.size(X.login_forms(F.col("f"))).alias("logins"), F.size(X.search_forms(F.col("f"))).alias("searches"))


def structured_data(spark, d):
    k = F.col("p_partkey")
    p = _many(spark, d, "part", "p_partkey").select("p_partkey", extract("structured", _page("<meta property='og:title' content='", F.col("p_name"), "'><meta name='twitter:card' content=c><meta name=Author content=a", k, "><script type='application/ld+json'>{\"@graph\":[{\"@type\":\"Product\",\"sku\":", k,
                "}]}</script><div itemscope itemtype='https://schema.org/Offer'><span itemprop=price>", F.col("p_size"), "</span></div><div vocab='https://schema.org/' typeof=Brand><b property=name>", F.col("p_brand"), "</b></div>")).alias("s"))
    return p.select("p_partkey", F.col("s.open_graph")["title"].alias("title"), F.col("s.twitter")["card"].alias("card"), F.col("s.meta")["author"].alias("author"), F.get_json_object(F.col("s.json_ld")[0], "$.sku").cast("long").alias("sku"),
                    F.get_json_object(F.col("s.microdata")[0], "$.price").cast("int").alias("price"), F.get_json_object(F.col("s.rdfa")[0], "$.name").alias("brand"), F.array_join("s.types", ",").alias("types"))


def embedded_json(spark, d):
    p = _many(spark, d, "orders", "o_orderkey").select("o_orderkey", extract("embedded_json", _page("<script>window.__INITIAL_STATE__ = {\"order\": ", F.col("o_orderkey"), ", \"s\": \"", F.col("o_orderstatus"), "\"};</script><script type='application/json' id=x>{\"c\":", F.col("o_custkey"), "}</script><script type='application/json'>bad</script>")).alias("j"))
    return p.select("o_orderkey", F.get_json_object(F.col("j")["__INITIAL_STATE__"], "$.s").alias("status"), F.get_json_object(F.col("j")["x"], "$.c").cast("long").alias("custkey"), F.size("j").alias("blocks"))


_FIELDS = ("csrf_token csrftoken _csrf csrf authenticity_token _token token xsrf_token xsrftoken _xsrf __RequestVerificationToken form_build_id _wpnonce my-Token".split())
_METAS = ("csrf-token csrf_token x-csrf-token xsrf-token xsrf_token x-xsrf-token".split())


def csrf_tokens(spark, d):
    """Every customer's page has one source of tokens, of all the kinds and names in turn."""
    k, n = F.col("c_custkey"), len(_FIELDS) + len(_METAS) + 6
    cases = [_page(f"<form><input type=hidden name={x} value=f", k, "><input type=text name=csrf value=no></form><input type=hidden name=_csrf value=outside>") for x in _FIELDS]
    cases += [_page(f"<meta name={x.upper()} content=m", k, "><meta name=csrf-param content=no>") for x in _METAS]
    cases += [_page("<script>var csrf_token = 'j", k, "'; csrf_token = 'later';</script>"), _page('<script>{"a": 1, csrfToken: "j', k, '"}</script>'), _page("<script>authenticity_token='j", k, "'</script>"), _page("<script>XSRFTOKEN : 'j", k, "'</script>"),
              _page("<div data-csrf-token=d", k, "></div>"), _page("<form><input type=hidden name=data-token value=f></form><div data-token=d", k, "></div>")]
    html = F.get(F.array(*cases), F.pmod(k, F.lit(n)).cast("int"))
    p = _many(spark, d, "customer", "c_custkey").select("c_custkey", extract("csrf_tokens", html).alias("t"))
    return p.select("c_custkey", F.explode("t").alias("name", "token"))


_TRAPS = [("<a href='/bot-trap'></a>", "hidden_link", 0.8), ("<a href='/x' style='display: none; visibility: hidden'>t</a>", "invisible", 0.7), ("<p style='position:absolute;left:-9999px'>t</p>", "off_screen", 0.7), ("<div style='width:0px;height:0'>t</div>", "zero_size", 0.8),
          ("<b style='opacity: 0'>t</b>", "transparent", 0.5), ("<input type=text name=honeypot>", "suspicious_field", 0.5), ("<button onclick='f()' style='width:1px'></button>", "mouse_trap", 0.6), ("<a href='/x' style='display:none'>t</a>", None, 0.0)]


def page_traps(spark, d):
    """One trap of each kind, and what isn't one, in turn; every fourth page has five of them."""
    k = F.pmod("c_custkey", F.lit(len(_TRAPS))).cast("int")
    html = F.repeat(F.get(F.array(*[F.lit(h) for h, _, _ in _TRAPS]), k), F.when(F.pmod(F.floor(F.col("c_custkey") / 8), F.lit(4)) == 0, 5).otherwise(1))
    h = F.col("h")
    p = _many(spark, d, "customer", "c_custkey").select("c_custkey", extract("honeypots", html).alias("h"))
    return p.select("c_custkey", F.get(h["found"], F.lit(0))["kind"].alias("kind"), F.get(h["found"], F.lit(0))["confidence"].alias("confidence"), h["count"].alias("n"), h["risk"].alias("risk"), F.size(h["advice"]).alias("advice"))


_PROOFS = [("<div class='g-recaptcha'></div>", "reCAPTCHA", 2), ("<script src='https://www.google.com/recaptcha/api.js'></script>", "reCAPTCHA v2", 2), ("<script>grecaptcha.execute()</script>", "reCAPTCHA v3", 2), ("<div class=h-captcha></div>", "hCaptcha", 2),
           ("<div class=cf-turnstile></div>", "Cloudflare Turnstile", 1), ("<p>Ray  ID: 1</p>", "Cloudflare Challenge", 1), ("<script src=//x.arkoselabs.com/f></script>", "FunCaptcha", 1), ("<div id=geetest></div>", "GeeTest", 1), ("<img src='/c.png' alt='Verify'>", "Simple CAPTCHA", 1),
           ("<p>Please verify you're human</p>", "Custom CAPTCHA", 1), ("<iframe src=/f id=challenge-x></iframe>", "", 0), ("<h1>Access Denied</h1><iframe title='Challenge'></iframe>", "Custom CAPTCHA", 2), ("<p>t</p>", "", 0)]


def page_proofs(spark, d):
    """Every kind of CAPTCHA in turn, and pages without."""
    html = F.get(F.array(*[F.lit(h) for h, _, _ in _PROOFS]), F.pmod("c_custkey", F.lit(len(_PROOFS))).cast("int"))
    p = _many(spark, d, "customer", "c_custkey").select("c_custkey", extract("captcha", html).alias("c"))
    return p.select("c_custkey", F.col("c.detected").alias("captcha"), F.array_join("c.types", ",").alias("types"), F.col("c.confidence").alias("confidence"))


def images_in_context(spark, d):
    """A page for each part with three images, which must come by relevance."""
    k = F.col("p_partkey")
    html = _page("<body><h2>Parts</h2><img src=plain.png><section><p>Before ", k, "</p><figure itemprop=image><img src='", k, ".png' alt='", F.col("p_name"), "' title=t id=i", k, " class='a b'><figcaption> Caption ", k, " </figcaption></figure></section>",
                 "<a href=/next>n</a><div><a href=/p", k, "><img src=linked.png alt='only alt' aria-label=lab></a></div></body>")
    i = _many(spark, d, "part", "p_partkey").select("p_partkey", F.posexplode(extract("images_in_context", html)).alias("rank", "i"))
    return i.select("p_partkey", "rank", F.col("i.src").alias("src"), F.col("i.position").alias("position"), F.col("i.caption").alias("caption"), F.col("i.context").alias("context"), F.col("i.relevance").alias("relevance"), F.col("i.itemprop").alias("itemprop"),
                    F.array_join(F.transform("i.nearby_headings", lambda h: h["text"]), "|").alias("headings"), F.array_join(F.transform("i.related_links", lambda x: F.concat(x["relationship"], F.lit(":"), x["href"])), "|").alias("links"), F.array_join("i.class", " ").alias("classes"))


def _headers():
    k = F.col("event_id")
    w = lambda n, m, c: F.when(F.pmod(k, F.lit(m)) == 0, F.struct(F.lit(n).alias("k"), F.lit(c).alias("v")))
    return F.map_from_entries(F.array_compact(F.array(w("Strict-Transport-Security", 2, "max-age=31536000; includeSubDomains"), w("Content-Security-Policy", 3, "default-src 'self'; script-src 'unsafe-inline' 'unsafe-eval'"), w("X-Frame-Options", 5, "ALLOW-FROM x"),
                                                     w("Referrer-Policy", 7, "origin"), w("CF-RAY", 11, "x"), w("Server", 13, "cloudflare"), w("x-amz-cf-id", 17, "y"), w("X-XSS-Protection", 19, "1"))))


def header_scores(spark, d):
    e = _t(spark, d, "events").select("event_id", S.header_report(_headers()).alias("r"))
    return e.select("event_id", F.col("r.score").cast("int").alias("score"), F.col("r.rating").alias("rating"), F.size("r.missing").alias("missing"))


def header_remarks(spark, d):
    e = _t(spark, d, "events").select("event_id", S.header_remarks(_headers()).alias("r"))
    return e.select("event_id", F.array_join("r.issues", "; ").alias("issues"), F.size("r.advice").alias("advice"))


def _signs():
    return [(i, h, c, s, b) for i, (_, hs, cs, ss, bs) in enumerate(S.FIREWALLS) for h, c, s, b in [*((x, "", "", "") for x in hs), *(("", x, "", "") for x in cs), *(("", "", x, "") for x in ss), *(("", "", "", x) for x in bs)]]


def _signs_sql() -> str:
    """All signs against all rows: 3 points for a header, 2 for a cookie, 4 for the server's name, 1 for the body; the most points, then the first firewall."""
    values = ", ".join(f"({i}, '{h}', '{c}', '{s}', '{b}')" for i, h, c, s, b in _signs())
    names = ", ".join(f"({i}, '{n}')" for i, (n, *_) in enumerate(S.FIREWALLS))
    return f"""WITH t(firewall, header, cookie, server, body) AS (VALUES {values}), n(f, name) AS (VALUES {names}), p AS (SELECT t.*, s.firewall AS f, sum(CASE WHEN s.header <> '' AND s.header = t.header THEN 3 WHEN s.cookie <> '' AND contains('x' || t.cookie, s.cookie) THEN 2
 WHEN s.server <> '' AND t.server <> '' AND contains('my ' || t.server, s.server) THEN 4 WHEN s.body <> '' AND contains('<p>' || t.body, s.body) THEN 1 ELSE 0 END)::INT AS score FROM t, t AS s GROUP BY ALL)
 SELECT firewall, header, cookie, server, body, max(score) AS score, arg_max(name, (score, -f)) AS name FROM p JOIN n USING (f) GROUP BY firewall, header, cookie, server, body"""


def firewall_signs(spark, d):
    """All signs of all firewalls, one a row: each header, part of a cookie, of the server's name and of the body."""
    rows = _signs()
    ship(spark)
    t = spark.createDataFrame(rows, "firewall int, header string, cookie string, server string, body string")
    both = F.map_from_entries(F.array_compact(F.array(F.when(F.col("header") != "", F.struct(F.initcap("header"), F.lit("1"))), F.when(F.col("server") != "", F.struct(F.lit("SERVER"), F.concat(F.lit("my "), F.upper("server")))))))
    w = S.firewall(both, F.array(F.concat(F.lit("x"), F.col("cookie"))), F.concat(F.lit("<p>"), F.upper("body")))
    return t.select("firewall", "header", "cookie", "server", "body", w["name"].alias("name"), w["score"].alias("score"))


def firewalls(spark, d):
    e = _t(spark, d, "events").select("event_id", S.firewall(_headers(), F.array(F.when(F.pmod("event_id", F.lit(23)) == 0, F.lit("bm_sv")).otherwise(F.lit("a"))), F.lit("body")).alias("w"))
    return e.select("event_id", F.col("w.name").alias("name"), F.col("w.score").alias("score"), F.col("w.confidence").alias("confidence"))


_H = "(event_id % 2 = 0)::INT AS a, (event_id % 3 = 0)::INT AS b, (event_id % 5 = 0)::INT AS c, (event_id % 7 = 0)::INT AS e, (event_id % 19 = 0)::INT AS g"
_F = "CASE WHEN event_id % 11 = 0 THEN 3 ELSE 0 END + CASE WHEN event_id % 13 = 0 THEN 4 ELSE 0 END AS cf, CASE WHEN event_id % 17 = 0 THEN 3 ELSE 0 END AS aws, CASE WHEN event_id % 23 = 0 THEN 2 ELSE 0 END AS ak"
QUERIES = {
    "html_tables": (html_tables, "SELECT c_nationkey, c_custkey AS cust_key, c_name AS name FROM customer"),
    "table_report": (table_report, "SELECT n_regionkey, count(*)::INT AS rows, 3 AS columns, string_agg(n_name, '|' ORDER BY n_name || '<') AS names FROM nation GROUP BY n_regionkey"),
    "page_meta": (page_meta, """SELECT p_partkey, CASE WHEN i <> 0 THEN 'P ' || p_partkey END AS title, CASE WHEN i <> 1 THEN 'about ' || p_partkey END AS description, CASE WHEN i <> 2 THEN 'a|b|c' || p_partkey ELSE '' END AS keywords, CASE WHEN i <> 3 THEN '/c/' || p_partkey END AS canonical, 'pt-BR' AS language,
 CASE WHEN i <> 4 THEN 'm' || p_partkey ELSE '2020-01-01' END AS last_modified, CASE WHEN i <> 5 THEN '1one|2two' || p_partkey || '|' ELSE '' END || '2last' || CASE WHEN i <> 6 THEN '|6six' ELSE '' END AS headings FROM (SELECT p_partkey, p_partkey % 8 AS i FROM part)"""),
    "spanned_tables": (spanned_tables, "SELECT n_nationkey, 2 AS tables, 'A' || n_nationkey || ',B,;,c,d e;' || n_name || ',,' AS first, 'xinner,inner;inner,' AS second FROM nation"),
    "header_values": (header_values, f"""SELECT c_custkey, header, score, 9 AS missing, 'F' AS rating FROM customer JOIN (SELECT unnest(range({len(_VALUES)})) AS i, unnest({[v[0] for v in _VALUES]}) AS header, unnest({[v[2] for v in _VALUES]}) AS score) ON c_custkey % {len(_VALUES)} = i"""),
    "page_images": (page_images, "SELECT p_partkey, '/img/' || p_partkey || '.png' AS src, p_size::INT AS width, CAST(NULL AS INT) AS height, p_partkey % 3 = 0 AS decorative, 'div' AS parent FROM part"),
    "page_forms": (page_forms, "SELECT s_suppkey, 1 + (s_suppkey % 2 = 0)::INT AS forms, 'https://h.example/login?s=' || s_suppkey AS action, 'POST' AS method, true AS csrf, 3 AS fields, s_name AS user, 'User' AS label, 20 AS maxlength, 'Go' AS submit, 1 AS logins, (s_suppkey % 2 = 0)::INT AS searches FROM supplier"),
    "structured_data": (structured_data, "SELECT p_partkey, p_name AS title, 'c' AS card, 'a' || p_partkey AS author, p_partkey AS sku, p_size::INT AS price, p_brand AS brand, 'Offer,Product' AS types FROM part"),
    "embedded_json": (embedded_json, "SELECT o_orderkey, o_orderstatus AS status, o_custkey AS custkey, 2 AS blocks FROM orders"),
    "csrf_tokens": (csrf_tokens, f"""WITH c AS (SELECT c_custkey, (c_custkey % {len(_FIELDS) + len(_METAS) + 6})::INT AS i FROM customer), n AS (SELECT c_custkey, i, unnest(CASE WHEN i < 14 THEN [{_FIELDS}[i + 1]] WHEN i < 20 THEN [{_METAS}[i - 13]]
 WHEN i = 20 THEN ['csrf_token', 'CSRF_TOKEN', '_token'] WHEN i = 21 THEN ['csrfToken'] WHEN i = 22 THEN ['authenticity_token', '_token'] WHEN i = 23 THEN ['xsrfToken'] WHEN i = 24 THEN ['data-csrf-token'] ELSE ['data-token'] END) AS name FROM c)
 SELECT c_custkey, name, CASE WHEN i < 14 THEN 'f' WHEN i < 20 THEN 'm' WHEN i < 24 THEN 'j' ELSE 'd' END || c_custkey AS token FROM n"""),
    "page_traps": (page_traps, f"""WITH t AS (SELECT unnest(range(8)) AS i, unnest({[k for _, k, _ in _TRAPS if k] + [None]}) AS kind, unnest({[c for _, _, c in _TRAPS]}) AS confidence), c AS (SELECT c_custkey, c_custkey % 8 AS i, CASE WHEN (c_custkey // 8) % 4 = 0 THEN 5 ELSE 1 END AS n FROM customer)
 SELECT c_custkey, kind, CASE WHEN kind IS NOT NULL THEN confidence END::DOUBLE AS confidence, CASE WHEN kind IS NULL THEN 0 ELSE n END AS n, CASE WHEN kind IS NULL THEN 'none' WHEN n = 5 OR confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS risk,
 CASE WHEN kind IS NULL THEN 0 WHEN kind IN ('hidden_link', 'suspicious_field', 'mouse_trap') THEN 6 ELSE 5 END AS advice FROM c JOIN t USING (i)""".replace("None", "NULL")),
    "page_proofs": (page_proofs, f"""SELECT c_custkey, types <> '' AS captcha, types, n * 0.25::DOUBLE AS confidence FROM customer JOIN (SELECT unnest(range({len(_PROOFS)})) AS i, unnest({[t for _, t, _ in _PROOFS]}) AS types, unnest({[n for _, _, n in _PROOFS]}) AS n) ON c_custkey % {len(_PROOFS)} = i"""),
    "images_in_context": (images_in_context, """SELECT p_partkey, 0 AS rank, p_partkey || '.png' AS src, 2 AS position, 'Caption ' || p_partkey AS caption, 'Caption ' || p_partkey AS context, 13 AS relevance, 'image' AS itemprop, '' AS headings, '' AS links, 'a b' AS classes FROM part UNION ALL
 SELECT p_partkey, 1, 'linked.png', 3, '', 'Image described as: only alt Image labeled as: lab', 4, NULL, '', 'parent:/p' || p_partkey, '' FROM part UNION ALL SELECT p_partkey, 2, 'plain.png', 1, '', 'Before ' || p_partkey || ' Caption ' || p_partkey, 1, NULL, 'Parts', '', '' FROM part"""),
    "header_remarks": (header_remarks, """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'content-security-policy: allows unsafe-inline; content-security-policy: allows unsafe-eval' END], lambda x: x IS NOT NULL), '; ') AS issues,
 (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 1 END + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END + 1 + 1 + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 1 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 1 END + 4)::INT AS advice FROM events"""),
    "firewall_signs": (firewall_signs, _signs_sql()),
    "header_scores": (header_scores, f"""SELECT event_id, score, CASE WHEN p >= 95 THEN 'A+' WHEN p >= 85 THEN 'A' WHEN p >= 70 THEN 'B' WHEN p >= 50 THEN 'C' WHEN p >= 30 THEN 'D' ELSE 'F' END AS rating, missing FROM
 (SELECT event_id, s AS score, s * 100.0 / 69 AS p, missing FROM (SELECT event_id, 8*a + 7*b + 5*c + 3*e + 2*g AS s, 10 - a - b - c - e - g AS missing FROM (SELECT event_id, {_H} FROM events)))"""),
    "firewalls": (firewalls, f"""SELECT event_id, CASE WHEN s = 0 THEN NULL WHEN cf = s THEN 'Cloudflare' WHEN aws = s THEN 'AWS WAF' ELSE 'Akamai' END AS name, s AS score, least(s / 10.0, 1.0)::DOUBLE AS confidence FROM (SELECT *, greatest(cf, aws, ak) AS s FROM (SELECT event_id, {_F} FROM events))"""),
}
