"""What queries hold at once doesn't grow with their tables, and odd rows of larger tables don't change results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.operators.extract import extract
from weftline.plans import registry, rendered


def test_pages_of_tables_stay_short(spark, tmp_path, monkeypatch):
    """All customers of one nation come back though pages beyond 200,000 characters are lost on the way."""
    spark.range(20_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), F.lit(3).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(rendered, "extract", lambda name, html: extract(name, F.when(F.length(html) <= 200_000, html)))
    got = rendered.html_tables(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(3, i, f"Customer#{i}") for i in range(20_000)]


def _equals_sql(spark, folder, name, tables):
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
    got = registry.queries()[name](spark, str(folder))
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()[name]).select(*[f'"{x}"' for x in got.columns]).fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    return rows


_TITLES = ("Cut &amp", "A &amp; B &copy; &quot;C&quot;", "&ampx &amp;amp &copy, &#38", "plain", "R&D")


def _titled(spark):
    return spark.createDataFrame([(i, f"https://h.example/en/{i}", f'<html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1><a href="/x?a=1&amp;b">x</a></body></html>') for i, t in enumerate(_TITLES)], "page_id long, url string, html string")


def test_cut_references_of_anchor_counts(spark, tmp_path):
    assert (1, "Cut &amp") in {r[1:] for r in _equals_sql(spark, tmp_path, "anchor_counts", {"pages": _titled(spark)})}


def test_candidates_once(spark, tmp_path):
    """Two pages whose URLs differ by their last slash are one candidate."""
    urls = ("https://h.example/", "https://h.example/de/1", "https://h.example/de/1/", "https://h.example/fr/2", "https://h.example/en/3?utm_source=x")
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert _equals_sql(spark, tmp_path, "crawl_candidates", {"pages": pages}) == [("https://h.example/de/1",)]


def test_cut_references_of_page_content(spark, tmp_path):
    assert "Cut &amp" in {r[1] for r in _equals_sql(spark, tmp_path, "page_content", {"pages": _titled(spark)})}


@pytest.mark.parametrize("name", ["images_in_context", "page_meta", "structured_data", "typed_items", "page_images"])
def test_pages_of_one_file_are_spread(spark, tmp_path, name):
    """A small file of many parts isn't a single task's Python."""
    part = spark.range(9).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit(40).alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "RepartitionByExpression" in plan[plan.index("ArrowEvalPython"):]


def test_keywords_of_pages_are_one_python_step(spark, tmp_path):
    spark.createDataFrame([(1, "<title>red apples</title><p>" + "green pears " * 9)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    k = registry.queries()["page_keywords"](spark, str(tmp_path))
    plan = k._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    assert [(r["rank"], r["keyword"], r["n"]) for r in k.collect()] == [(1, "green", 9), (2, "pears", 9), (3, "red", 3), (4, "apples", 3)]
