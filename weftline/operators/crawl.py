"""Crawling as traversal of a page corpus: frontier levels by depth, visited pages left out by anti joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import remove, scratch


def _cut(df: DataFrame, name: str) -> DataFrame:
    """A written copy in the shared folder: a level's lineage ends there, and lost executors don't matter."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int, resume: str | None = None) -> DataFrame:
    """url, depth, discovered_from of all that is reachable from seeds (url) over edges (from_url, to_url) in at most max_depth steps.

    Each URL has its least depth and, of its discoverers there, the least; seeds have none. Null URLs are left out. The edges are worked
    out once and written bucketed by from_url, so that each level moves itself and not the edges. resume: a folder (shared) that keeps
    the levels; a later call with it goes on behind the last one.
    """
    spark = seeds.sparkSession
    name, at = f"weftline_edges_{uuid.uuid4().hex}", scratch(spark, "edges")
    known = edges.filter("from_url is not null and to_url is not null").select("from_url", "to_url").distinct()
    known.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "from_url").option("path", at).saveAsTable(name)
    e = spark.table(name)

    def kept(df: DataFrame, depth: int) -> DataFrame:
        if resume is None:
            return _cut(df, "level")
        done = load_level(spark, resume, depth)
        if done is None:
            df.write.mode("overwrite").parquet(f"{resume}/level={depth}")
            done = load_level(spark, resume, depth)
        return done

    try:
        first = seeds.filter("url is not null").select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("discovered_from"))
        level = seen = kept(first, 0)
        for depth in range(1, max_depth + 1):
            step = (level.join(e, level.url == e.from_url).groupBy(F.col("to_url").alias("url")).agg(F.min("from_url").alias("discovered_from"))
                    .join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), "discovered_from"))
            level = kept(step, depth)
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, at)
    return seen


_LEVEL = "url string, depth int, discovered_from string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_level(spark: SparkSession, folder: str, depth: int) -> DataFrame | None:
    """A level that a crawl with resume has finished; None where it hasn't."""
    at = f"{folder}/level={depth}"
    return spark.read.schema(_LEVEL).parquet(at) if _exists(spark, f"{at}/_SUCCESS") else None


def resume_info(spark: SparkSession, folder: str) -> dict:
    """can_resume, levels, visited (URLs of all levels) and frontier (of the last) of a crawl's folder."""
    levels = []
    while (x := load_level(spark, folder, len(levels))) is not None:
        levels.append(x.count())
    return {"can_resume": bool(levels), "levels": len(levels), "visited": sum(levels), "frontier": levels[-1] if levels else 0}


def new_urls(found: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct found URLs that aren't visited."""
    return found.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def robots_rules(robots: DataFrame) -> DataFrame:
    """domain, agent, allow, prefix, delay, line from robots(domain, text): a row for each rule and agent of its group."""
    lines = robots.select("domain", F.posexplode(F.split("text", "\r?\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", "")))
    kv = lines.select("domain", "line", F.lower(F.trim(F.regexp_extract("raw", "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract("raw", "^[^:]*:(.*)$", 1)).alias("v"))
    g = kv.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("line", "k", "v"))).alias("ls"))
    # groups: agents in a row share the rules that follow; a rule ends the row
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(True).alias("open"), F.array().cast("array<struct<agent:string,allow:boolean,prefix:string,delay:double,line:int>>").alias("out"))

    def step(acc, x):
        agents = F.when(acc["open"], F.concat(acc["agents"], F.array(F.lower(x["v"])))).otherwise(F.array(F.lower(x["v"])))
        rule = lambda allow, prefix, delay: F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), allow.alias("allow"), prefix.alias("prefix"), delay.alias("delay"), x["line"].alias("line")))
        none = F.lit(None)
        return (F.when(x["k"] == "user-agent", F.struct(agents.alias("agents"), F.lit(True).alias("open"), acc["out"].alias("out")))
                .when(x["k"].isin("allow", "disallow"), F.struct(acc["agents"].alias("agents"), F.lit(False).alias("open"), F.concat(acc["out"], rule((x["k"] == "allow") | (x["v"] == ""), x["v"], none.cast("double"))).alias("out")))
                .when(x["k"] == "crawl-delay", F.struct(acc["agents"].alias("agents"), F.lit(False).alias("open"), F.concat(acc["out"], rule(none.cast("boolean"), none.cast("string"), x["v"].try_cast("double"))).alias("out"))).otherwise(acc))

    return g.select("domain", F.explode(F.aggregate("ls", start, step)["out"]).alias("r")).select("domain", "r.*")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """url, domain, path with allowed: by the domain's first rule for the agent (else for *) whose prefix the path begins with; true where none does."""
    own = rules.filter(F.col("allow").isNotNull() & F.col("agent").isin(agent.lower(), "*")).groupBy("domain", "agent").agg(F.sort_array(F.collect_list(F.struct("line", "allow", "prefix"))).alias("rs"))
    best = own.groupBy("domain").agg(F.max_by("rs", F.when(F.col("agent") == agent.lower(), 2).otherwise(1)).alias("rs"))
    first = F.filter("rs", lambda r: F.col("path").startswith(r["prefix"]))
    return urls.join(best, "domain", "left").withColumn("allowed", F.coalesce(F.get(first, F.lit(0))["allow"], F.lit(True))).drop("rs")


def crawl_delays(rules: DataFrame, agent: str = "*") -> DataFrame:
    """domain, delay: the first delay given to the agent or to *."""
    return rules.filter(F.col("delay").isNotNull() & F.col("agent").isin(agent.lower(), "*")).groupBy("domain").agg(F.min_by("delay", "line").alias("delay"))


def skipped_paths(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """domain, path of the URLs that robots rules refuse, each once."""
    return robots_allowed(urls, rules, agent).filter("not allowed").select("domain", "path").distinct()


def worth_crawling(found: DataFrame, visited: DataFrame, rules: DataFrame, keep: Column, agent: str = "*") -> DataFrame:
    """Distinct rows of found(url, domain, path) to be crawled: not visited, allowed by robots rules, and meeting keep (scope and filters)."""
    d = found.filter(keep).select("url", "domain", "path").distinct().join(visited.select("url"), "url", "left_anti")
    return robots_allowed(d, rules, agent).filter("allowed").drop("allowed")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    lines = F.transform(F.split("text", "\r?\n"), lambda s: F.trim(s))
    return robots.select("domain", F.explode(F.filter(lines, lambda s: F.lower(s).startswith("sitemap:"))).alias("s")).select("domain", F.trim(F.regexp_extract("s", "^[^:]*:(.*)$", 1)).alias("sitemap"))


def sitemap_urls(sitemaps: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """url (of the sitemap), loc, lastmod, changefreq, priority of sitemaps(url, xml); names' prefixes don't matter. Index files give their parts' locations as they are."""
    fields = [F.expr(f"xpath_string(e, '/*/*[local-name()=\"{k}\"]')").alias(k) for k in ("loc", "lastmod", "changefreq", "priority")]
    entries = F.regexp_extract_all("xml", F.lit(r"(?s)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), 1)
    return sitemaps.select("url", F.explode(entries).alias("e")).select("url", *[F.nullif(F.trim(f), F.lit("")).alias(k) for f, k in zip(fields, ("loc", "lastmod", "changefreq", "priority"))])


def sitemap_closure(sitemaps: DataFrame, roots: DataFrame, most: int = 10) -> DataFrame:
    """Entries (as of sitemap_urls) of roots(url) and of all sitemaps(url, xml) that index files lead to from there, at most `most` steps down; each sitemap once.

    Sitemaps that aren't in the table give nothing.
    """
    index = F.col("xml").rlike(r"<(?:[A-Za-z0-9]+:)?sitemapindex[\s>]")
    links = sitemap_urls(sitemaps.filter(index)).select(F.col("url").alias("from_url"), F.col("loc").alias("to_url"))
    reached = crawl(roots, links, most).select("url")
    return sitemap_urls(sitemaps.filter(~index).join(reached, "url", "left_semi"))


def discovered_sitemaps(domains: DataFrame, robots: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """domain, sitemap: what robots texts name and explicit(domain, sitemap) adds; where neither gives any, the two usual places."""
    named = robots_sitemaps(robots)
    if explicit is not None:
        named = named.unionByName(explicit.select("domain", "sitemap"))
    named = named.distinct()
    usual = domains.select("domain").distinct().join(named.select("domain"), "domain", "left_anti")
    places = F.explode(F.array(*[F.concat(F.lit("https://"), F.col("domain"), F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml")]))
    return named.unionByName(usual.select("domain", places.alias("sitemap")))
