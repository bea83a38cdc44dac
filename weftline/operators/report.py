"""Reports over extracted pages: counts in the JVM, one row each, whatever the number of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_report(pages: DataFrame) -> DataFrame:
    """part, name, n of pages(page_type, content as extract("content") gives it): page types, languages, headings by level, and how many have a description, keywords or a canonical link."""
    c = F.col("content")
    has = lambda name, x: F.when(x, F.struct(F.lit("meta").alias("part"), F.lit(name).alias("name")))
    one = F.array_compact(F.concat(F.array(F.struct(F.lit("page_type").alias("part"), F.col("page_type").alias("name")), F.when(F.coalesce(c["language"], F.lit("")) != "", F.struct(F.lit("language").alias("part"), c["language"].alias("name"))),
                                           has("description", F.coalesce(c["description"], F.lit("")) != ""), has("keywords", F.size(c["keywords"]) > 0), has("canonical", F.coalesce(c["canonical"], F.lit("")) != "")),
                                   F.transform(c["headings"], lambda h: F.struct(F.lit("heading").alias("part"), F.concat(F.lit("h"), h["level"].cast("string")).alias("name")))))
    return pages.select(F.explode(one).alias("x")).groupBy("x.part", "x.name").agg(F.count("*").alias("n"))


def counted_report(pages: DataFrame, n: Column, depth: str = "depth") -> DataFrame:
    """depth, total, pages: how many things (images, tables) pages hold and how many pages hold any, in all (null) and by depth. Depths without any have no row."""
    return pages.select(F.col(depth).alias("depth"), n.alias("_n")).filter("_n > 0").rollup("depth").agg(F.sum("_n").cast("long").alias("total"), F.count("*").alias("pages"))


def keyphrase_report(phrases: DataFrame, top: int = 20) -> DataFrame:
    """phrase, words, pages: the phrases of most words, then of most pages (then by name); the limit is what the report is for."""
    n = phrases.groupBy("phrase").agg(F.count("*").alias("pages")).withColumn("words", F.size(F.split("phrase", " ")))
    return n.orderBy(F.desc("words"), F.desc("pages"), "phrase").limit(top).select("phrase", "words", "pages")


def by_type(structured: Column, kind: str) -> Column:
    """The JSON-LD and microdata items of a type, as JSON."""
    return F.filter(F.concat(structured["json_ld"], structured["microdata"]), lambda j: (F.get_json_object(j, "$.@type") == kind) | F.coalesce(F.array_contains(F.from_json(F.get_json_object(j, "$.@type"), "array<string>"), kind), F.lit(False)))


def has_type(structured: Column, kind: str) -> Column:
    return F.array_contains(structured["types"], kind)


def form_by_id(forms: Column, form_id: str) -> Column:
    """The first form of an id; null without one."""
    return F.get(F.filter(forms, lambda f: f["id"] == form_id), F.lit(0))


def text_entry(url: Column, status: Column, depth: Column, content_type: Column, success: Column, error: Column, links: Column, images: Column, keywords: Column, phrases: Column, tables: Column) -> Column:
    """A result as lines of text: figures, and samples of 5 links, 3 images, 5 keywords, 5 phrases and the first 3 x 3 cells of a table. images: structs of src and alt."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))

    def some(title: str, label: str, xs: Column, most: int, shown) -> Column:
        n = F.coalesce(F.size(xs), F.lit(0))
        rest = F.when(n > most, F.concat(F.lit("  - ... and "), (n - most).cast("string"), F.lit(" more\n"))).otherwise("")
        lines = F.concat(F.lit(f"{label}:\n"), F.array_join(F.transform(F.slice(xs, 1, most), lambda x: F.concat(F.lit("  - "), shown(x), F.lit("\n"))), ""), rest)
        return F.concat(F.lit(f"{title}: "), n.cast("string"), F.lit("\n"), F.when(n > 0, lines).otherwise(""))

    row = lambda r: F.concat(F.lit("  | "), F.array_join(F.slice(r, 1, 3), " | "), F.when(F.size(r) > 3, " | ... ").otherwise(""), F.lit(" |\n"))
    first = F.get(tables, F.lit(0))
    n = F.coalesce(F.size(tables), F.lit(0))
    grid = F.when(n > 0, F.concat(F.lit("Sample Table Structure:\n"), F.array_join(F.transform(F.slice(first, 1, 3), row), ""), F.when(F.size(first) > 3, "  | ... |\n").otherwise(""),
                                  F.when(n > 1, F.concat(F.lit("  ... and "), (n - 1).cast("string"), F.lit(" more tables\n"))).otherwise(""))).otherwise("")
    return F.concat(F.lit("URL: "), url, F.lit("\nStatus: "), s(status), F.lit("\nDepth: "), s(depth), F.lit("\nContent Type: "), s(content_type), F.lit("\nSuccess: "), F.initcap(F.coalesce(success, F.lit(False)).cast("string")), F.lit("\n"),
                    F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("Error: "), error, F.lit("\n"))).otherwise(""), some("Links Found", "Sample Links", links, 5, lambda x: x),
                    some("Images Found", "Sample Images", images, 3, lambda i: F.concat(F.coalesce(i["src"], F.lit("No source")), F.lit(" (Alt: "), F.coalesce(i["alt"], F.lit("No alt text")), F.lit(")"))), some("Keywords Found", "Top Keywords", keywords, 5, lambda x: x),
                    some("Key Phrases Found", "Sample Key Phrases", phrases, 5, lambda x: x), F.lit("Tables Found: "), n.cast("string"), F.lit("\n"), grid)


def csv_row(url: Column, status: Column, depth: Column, content_type: Column, success: Column, error: Column, links: Column, images: Column, keywords: Column, phrases: Column, tables: Column) -> list[Column]:
    """The eleven columns of a result's line in a CSV file."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return [url.alias("URL"), s(status).alias("Status"), s(depth).alias("Depth"), s(content_type).alias("Content Type"), n(links).alias("Links Found"), F.coalesce(success, F.lit(False)).alias("Success"), F.coalesce(error, F.lit("")).alias("Error"),
            n(images).alias("Images Found"), n(keywords).alias("Keywords Found"), n(phrases).alias("Key Phrases Found"), n(tables).alias("Tables Found")]
