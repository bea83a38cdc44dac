"""Column functions of a page's HTML: Arrow-batched Python, one parse of a page however many functions are asked of it."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import page as P
from weftline.functions.soup import soup

_FIELD = "name string, type string, value string, id string, label string, placeholder string, required boolean, pattern string, maxlength int, minlength int, options array<string>"
#: name -> (function, Spark type, whether it takes the URL)
_FUNCTIONS = {
    "links": (P.links, "array<string>", True),
    "parsed": (P.parsed, "struct<links array<string>, title string, text string, meta map<string,string>>", True),
    "content": (P.content, "struct<title string, description string, keywords array<string>, canonical string, language string, headings array<struct<level int, text string>>, last_modified string>", True),
    "tables": (P.tables, "array<array<array<string>>>", False),
    "images": (P.images, "array<struct<src string, alt string, title string, class string, width string, height string, width_int int, height_int int, decorative boolean, parent_tag string, attrs map<string,string>>>", False),
    "images_in_context": (P.images_in_context, "array<struct<src string, alt string, title string, width string, height string, loading string, srcset string, sizes string, id string, class array<string>, position int, total int, caption string, "
                          "nearby_headings array<struct<level int, text string>>, related_links array<struct<href string, text string, relationship string>>, context string, itemprop string, relevance int>>", False),
    "keyword_text": (P.keyword_text, "string", False),
    "forms": (P.forms, f"array<struct<action string, method string, enctype string, id string, class string, name string, fields array<struct<{_FIELD}>>, submit_text string, has_file boolean, has_csrf boolean, has_captcha boolean, legends array<string>>>", True),
    "structured": (P.structured, "struct<json_ld array<string>, microdata array<string>, rdfa array<string>, open_graph map<string,string>, twitter map<string,string>, meta map<string,string>, types array<string>>", False),
    "embedded_json": (P.embedded_json, "map<string,string>", False),
    "language": (P.language, "struct<primary string, confidence double, methods map<string,string>, candidates array<struct<language string, share double>>>", True),
    "honeypots": (P.honeypots, "struct<found array<struct<kind string, tag string, confidence double>>, count int, risk string, advice array<string>>", False),
    "captcha": (P.captcha, "struct<detected boolean, types array<string>, confidence double>", False),
    "csrf_tokens": (P.csrf_tokens, "map<string,string>", False),
    "dedup_text": (P.dedup_text, "string", False),
}


@cache
def _udf(names: tuple[str, ...]):
    def run(html, url):
        tree = soup(html)
        return {n: _FUNCTIONS[n][0](tree, url) if _FUNCTIONS[n][2] else _FUNCTIONS[n][0](tree) for n in names}

    return F.udf(run, "struct<" + ", ".join(f"{n} {_FUNCTIONS[n][1]}" for n in names) + ">", useArrow=True)


def extract_many(names: list[str] | tuple[str, ...], html: Column, url: Column | None = None) -> Column:
    """A struct with a field for each of the page functions named; each page is parsed once."""
    return _udf(tuple(names))(html, url if url is not None else F.lit(None).cast("string"))


def extract(name: str, html: Column, url: Column | None = None) -> Column:
    """One of the page functions as a column: links, parsed, content, tables, images, images_in_context, keyword_text, forms, structured, embedded_json, language, honeypots, captcha, csrf_tokens, dedup_text."""
    return extract_many((name,), html, url)[name]


def closed_references(html: Column) -> Column:
    """HTML in which a character reference without its semicolon, such as a title cut in the middle of &amp; leaves, is text and not a character. Scripts change, too."""
    return F.regexp_replace(html, r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


@cache
def _phrases():
    return F.udf(lambda t: P.keyphrases(t), "array<string>", useArrow=True)


def keyphrases(text: Column) -> Column:
    return _phrases()(text)


# The rest stays in the JVM.

def kept_tables(tables: Column, min_rows: int = 2, min_columns: int = 2) -> Column:
    return F.filter(tables, lambda t: (F.size(t) >= min_rows) & F.exists(t, lambda r: F.size(r) >= min_columns))


def table_names(table: Column) -> Column:
    """Names from a table's first row: word characters, blanks as _, lower case; column_n where nothing is left."""
    return F.transform(table[0], lambda h, i: F.coalesce(F.nullif(F.lower(F.regexp_replace(F.trim(F.regexp_replace(h, r"[^\p{L}\p{N}_\s]", "")), r"\s+", "_")), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))


def login_forms(forms: Column) -> Column:
    about = lambda f: F.lower(F.concat_ws(" ", f["action"], f["id"], f["class"]))
    return F.filter(forms, lambda f: F.exists(f["fields"], lambda x: x["type"] == "password") & (about(f).rlike("login|signin|sign-in|auth") | (F.size(f["fields"]) <= 5)))


def search_forms(forms: Column) -> Column:
    return F.filter(forms, lambda f: F.lower(F.concat_ws(" ", f["action"], f["id"], f["class"], F.concat_ws(" ", F.transform(f["fields"], lambda x: x["name"])))).rlike("search|query|q|find"))


def forms_by_action(forms: Column, part: str) -> Column:
    return F.filter(forms, lambda f: f["action"].contains(part))
