"""Operator 8, quality rules: perplexity under a modified Kneser-Ney byte n-gram model, with a band for each language.

The counts of each language's (ORDER+1)-byte grams, their continuation counts and the discounts D1, D2, D3+ come from all documents
(gram_exchange: sorted key arrays, met by suffix). A document is scored with the model of the other half of its language, so that
it doesn't predict itself. Copies and near copies in a language (the groups of near_copies) lie in one half, and one of each group
counts in the model and the centre: copies don't predict each other, and the number of copies changes no figure.
A language's centre is the mean bits a byte over that text, its spread the middle half of its documents' bits a byte (over 1.349, which
makes it the deviation of a normal distribution; drawn towards the mean spread as if PRIOR_DOCS documents had that); the band is
[centre - LOWER * spread - SLACK/sqrt(bytes), centre + UPPER * spread + SLACK/sqrt(bytes)]: below lies repeated or formulaic text, above
it junk. Both bounds are so each language's own. Perplexity is 2 to the bits a byte.

Documents of small languages (fewer than LEAST_BYTES that count) are scored with the model of all languages together. Their centre is
the language's mean under it, drawn towards the mean of all text as if PRIOR_BYTES of that had been seen too; the band is wider by
twice the languages' spread around that mean, as far as the language's own bytes leave it open, and by what PRIOR_BYTES of junk at
8 bits a byte would shift the mean of all text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.llm.common import count_sorted, find, flat, packed, pick, table, unpack, written
from weftline.llm.gram_exchange import FAN, Low, _of_groups, exchange, score
from weftline.llm.near_copies import near_groups

ORDER = 4
BLOCK_BYTES = 32 << 20
#: Widths of the band in spreads of the language, and what short texts get besides in bits a byte, over the root of their bytes.
LOWER, UPPER, SLACK, PRIOR_DOCS = 4.0, 4.0, 3.0, 50
#: Languages with fewer bytes than this are judged under the model of all languages, with a centre that weighs like PRIOR_BYTES of other text.
LEAST_BYTES, PRIOR_BYTES = 20_000, 4_000


def _levels(g: np.ndarray, c: np.ndarray, order: int):
    """(k, keys, adjusted counts) from the highest order to 2: raw counts, below that the number of different preceding bytes."""
    keys, cnt = g, c
    yield order, keys, cnt
    for k in range(order - 1, 1, -1):
        keys, cnt = count_sorted(keys & ((1 << 8 * (k + 1)) - 1))
        yield k, keys, cnt


def kn_summary(order: int):
    def f(g: np.ndarray, c: np.ndarray):
        for k, keys, cnt in _levels(g, c, order):
            n = np.bincount(np.minimum(cnt, 5), minlength=6)
            yield 10 + k, np.arange(1, 5), n[1:5]
        yield 0, *count_sorted(keys & 0xFFFF)

    return f


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, by Chen and Goodman; 0.5, 1 and 1.5 where the corpus is too small to tell."""
    if not (n1 and n2):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(v, 0.0 if i == 0 else 0.05), i or 0.0) for i, v in enumerate(d)])


def _count_of_counts(cnt: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(cnt, 5), minlength=6)[1:5].tolist()


def kn_bits(order: int):
    """Cost function for gram_exchange: -log2 of the interpolated probability of each query gram's last byte."""

    def f(q: np.ndarray, mg: np.ndarray, mc: np.ndarray, low: Low) -> np.ndarray:
        level = {k: (keys, cnt) for k, keys, cnt in _levels(mg, mc, order)}
        k1 = np.flatnonzero(low.pair)
        level[1] = (k1, low.pair[k1])
        level[0] = count_sorted(k1 & 0xFF)
        p = np.full(len(q), 1 / 256)
        for k in range(order + 1):
            keys, cnt = level[k]
            if not len(keys):
                continue
            tag = low.tags.get(10 + k, {})
            d = discounts(*([tag.get(r, 0) for r in (1, 2, 3, 4)] if k > 1 else _count_of_counts(cnt)))
            cut = d[np.minimum(cnt, 3)]
            ctx, total = count_sorted(keys >> 8, cnt)
            freed = np.add.reduceat(cut, np.flatnonzero(np.concatenate(([True], np.diff(keys >> 8) != 0))))
            key = q & ((1 << 8 * (k + 1)) - 1)
            at, seen = find(ctx, key >> 8)
            ka, hit = find(keys, key)
            own = np.where(hit, cnt[ka] - cut[ka], 0.0)
            p = np.where(seen, (own + freed[at] * p) / total[at], p)
        return -np.log2(p)

    return f


def _judged(docs: DataFrame, order: int, lower: float, upper: float, slack: float, least: int, block_bytes: int, fan: int = FAN) -> tuple[DataFrame, int]:
    """docs: _id, _text, _lang. Returns for each row _k (key of id, text and language), _id, _grp, _size, _rate (bits a byte), the bounds _lo and
    _hi, null where there are no bytes, and _keep; and the number of blocks."""
    docs = _keyed(docs)
    near = written(near_groups(docs), "near")
    x, c, n, spent = exchange(docs.drop("_h", "_lk"), "_lang", order, kn_summary(order), kn_bits(order), block_bytes, max(least, 1), near, fan)
    run = score(order)

    def rate(z: pa.Table, costs: pa.Table) -> pa.Table:
        d = unpack(z)
        size, bits = run(z.column("_block")[0].as_py(), d, costs)
        with np.errstate(divide="ignore", invalid="ignore"):
            per = bits / size
        k = d.column("_k").to_numpy()
        once = np.zeros(len(k), bool)
        once[np.unique(k, return_index=True)[1]] = True
        counts = once & _of_groups(d, z.column("_block")[0].as_py(), costs.filter(pc.is_valid(costs.column("_k"))))[1]
        blank = [not (t or "").strip() for t in d.column("_text").to_pylist()]
        return pa.table({"_k": d.column("_k"), "_id": d.column("_id"),
                         "_grp": d.column("_grp"), "_size": pa.array(size), "_rate": pa.array(per, mask=size == 0), "_blank": pa.array(blank), "_counts": pa.array(counts)})

    kind = docs.schema["_id"].dataType.simpleString()
    r = x.groupBy("_block").cogroup(c.groupBy("_block")).applyInArrow(rate, f"_k long, _id {kind}, _grp string, _size long, _rate double, _blank boolean, _counts boolean")
    by = spent.withColumn("_under", F.col("_pooled") / F.col("_train"))
    mean = by.agg((F.sum("_pooled") / F.sum("_train")).alias("_mean"), F.sum("_train").alias("_all"), F.sum(F.col("_under") * F.col("_pooled")).alias("_sq")).select(
        "_mean", "_all", F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") / F.col("_all") - F.col("_mean") * F.col("_mean"))).alias("_spread"))
    weight, small = F.col("_train") / (F.col("_train") + PRIOR_BYTES), F.col("_train") < least
    centre = by.crossJoin(mean).select("_grp", F.when(small, weight * F.col("_under") + (1 - weight) * F.col("_mean")).otherwise(F.col("_spent") / F.col("_train")).alias("_centre"),
                                       F.when(small, 2 * F.col("_spread") * F.sqrt(1 - weight) + 8 * PRIOR_BYTES / (F.col("_all") + PRIOR_BYTES)).otherwise(0.0).alias("_wider"))
    r = written(r.join(centre, "_grp", "left"), "rates")  # some 50 bytes a document, so that nothing is scored twice
    q = F.percentile_approx("_rate", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000))  # one pass, merged from the tasks' summaries
    own = r.filter("_counts and _rate is not null").groupBy("_grp").agg(q.alias("_q"), F.count("*").alias("_docs")).select("_grp", "_docs", ((F.col("_q")[1] - F.col("_q")[0]) / 1.349).alias("_own"))
    pool = own.agg((F.sum(F.col("_own") * F.col("_docs")) / F.sum("_docs")).alias("_usual"))
    spread = own.crossJoin(pool).select("_grp", ((F.col("_own") * F.col("_docs") + F.col("_usual") * PRIOR_DOCS) / (F.col("_docs") + PRIOR_DOCS)).alias("_width"))
    r = r.join(spread, "_grp", "left")
    side = F.lit(float(slack)) / F.sqrt(F.nullif(F.col("_size"), F.lit(0))) + F.col("_wider")
    r = r.withColumn("_lo", F.col("_centre") - F.col("_width") * lower - side).withColumn("_hi", F.col("_centre") + F.col("_width") * upper + side)
    return r.withColumn("_keep", ~F.col("_blank") & F.col("_rate").between(F.col("_lo"), F.col("_hi"))), n


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_h", F.xxhash64("_id", "_text")).withColumn("_lk", F.xxhash64("_lang")).withColumn("_k", F.xxhash64("_h", "_lk"))


def _lang(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def quality_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, lower: float = LOWER,
                  upper: float = UPPER, slack: float = SLACK, least_bytes: int = LEAST_BYTES, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, lower, upper and keep for every row.

    Null, empty and blank texts are rejected, with null figures where there are no bytes. A null language counts as one of its own.
    Languages of fewer than least_bytes are judged under the model of all languages. Repeated rows are judged each and count once, texts
    of any length are judged whole, rows on a bound are kept. Other columns don't matter.
    """
    d = pick(docs, _id=id_col, _text=text_col, _lang=lang_col)
    r, _ = _judged(d.withColumn("_lang", _lang("_lang")), order, lower, upper, slack, least_bytes, block_bytes, fan)
    two = lambda c: F.round(F.pow(F.lit(2.0), F.col(c)), 6)
    return r.select(F.col("_id").alias("doc_id"), F.when(F.col("_grp") != "", F.col("_grp")).alias("lang"), F.col("_size").alias("n_bytes"), two("_rate").alias("perplexity"),
                    two("_lo").alias("lower"), two("_hi").alias("upper"), F.col("_keep").alias("keep"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """The rows of docs, all columns, that quality_bands keeps."""
    p = {"order": ORDER, "lower": LOWER, "upper": UPPER, "slack": SLACK, "least_bytes": LEAST_BYTES, "block_bytes": BLOCK_BYTES} | kw
    f, at = flat(docs)
    back = {at[text_col]: "_text", at[id_col]: "_id"}
    cols = [back.get(c, c) for c in f.columns]
    f = f.toDF(*cols)
    own = f.withColumn("_lang", _lang(at[lang_col]))
    r, n = _judged(own.select("_id", "_text", "_lang"), p["order"], p["lower"], p["upper"], p["slack"], p["least_bytes"], p["block_bytes"])
    block = F.pmod("_k", F.lit(2 * n)).cast("int")
    kept = r.filter("_keep").select("_k").distinct().withColumn("_block", block).repartition(max(n, 2), "_block")
    x = packed(_keyed(own).select(*cols, "_k"), block, max(n, 2))

    def keep(z: pa.Table, k: pa.Table) -> pa.Table:
        if not z.num_rows:
            return schema.empty_table()
        d = unpack(z)
        return d.select(cols).filter(pc.is_in(d.column("_k"), value_set=k.column("_k").combine_chunks()))

    schema = to_arrow_schema(f.schema)
    return x.groupBy("_block").cogroup(kept.groupBy("_block")).applyInArrow(keep, f.schema).toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands(table(spark, sf_dir, "documents"))


QUERIES = {"op8_quality_rules": op8_quality_rules}
