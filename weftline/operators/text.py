"""Keywords, n-grams and language scores of plain text: columns in the JVM, and Arrow-batched counts within a text, which need no shuffle."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.page import keywords as keywords_of
from weftline.functions.words import FREQUENT_WORDS, STOP_WORDS

_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case words without ASCII punctuation, of `least` characters or more, that aren't stop words or digits."""
    stop = sorted(STOP_WORDS)
    words = F.split(F.trim(F.regexp_replace(F.translate(F.lower(text), _PUNCT, ""), r"\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop) & ~w.rlike("^[0-9]+$"))


#: Python holds so many texts at a time, however many come in a batch.
_TEXTS = 64


def keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 20, least: int = 3, of=None) -> DataFrame:
    """id, rank, keyword, n, score: each text's most frequent tokens, ties by first occurrence; none for texts of fewer than ten words.

    A text's tokens are counted where the text is: nothing is shuffled. of: a function that gives the text of what the column holds,
    such as pages, in the same Python.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for r in (x.slice(i, _TEXTS) for x in batches for i in range(0, x.num_rows, _TEXTS)):
            at, rows = [], []
            for i, t in enumerate(r.column("text")):
                t = t.as_py()
                for k in keywords_of(of(t) if of else t, top, least):
                    at.append(i)
                    rows.append(k)
            rank, last = [], None
            for i in at:
                rank.append(rank[-1] + 1 if i == last else 1)
                last = i
            yield pa.RecordBatch.from_arrays([r.column("id").take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array([k["keyword"] for k in rows], pa.string()),
                                              pa.array([k["n"] for k in rows], pa.int64()), pa.array([k["score"] for k in rows], pa.float64())], names=["id", "rank", "keyword", "n", "score"])

    return d.mapInArrow(run, f"id {dict(d.dtypes)['id']}, rank int, keyword string, n long, score double")


def ngram_counts(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    grams = F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.array_join(F.slice("t", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    return t.select("id", F.explode(grams).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_PLACE = {k: i for i, k in enumerate(FREQUENT_WORDS)}
_LANGUAGES_OF: dict[str, list[str]] = {}
for _k, _own in FREQUENT_WORDS.items():
    for _w in set(_own):
        _LANGUAGES_OF.setdefault(_w, []).append(_k)


def word_language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, language, place, score: share of a text's words among each language's frequent ones, where over 1 %; none for texts of fewer than 20 words.

    One pass over the words, each looked up once for all languages.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for r in batches:
            at, langs, scores = [], [], []
            for i, t in enumerate(r.column("text").to_pylist()):
                words = _BLANKS.split((t or "").lower().strip(" \t\n\x0b\f\r"))
                if len(words) >= 20:
                    hits = Counter(k for w in words for k in _LANGUAGES_OF.get(w, ()))
                    for k, n in hits.items():
                        if n / len(words) > 0.01:
                            at.append(i)
                            langs.append(k)
                            scores.append(n / len(words))
            yield pa.RecordBatch.from_arrays([r.column("id").take(pa.array(at, pa.int64())), pa.array(langs, pa.string()), pa.array([_PLACE[k] for k in langs], pa.int32()), pa.array(scores, pa.float64())], names=["id", "language", "place", "score"])

    return d.mapInArrow(run, f"id {dict(d.dtypes)['id']}, language string, place int, score double")


def detect_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, language, score of the best language; ties by the languages' order."""
    s = word_language_scores(docs, id_col, text_col)
    best = F.max(F.struct("score", (-F.col("place")).alias("p"), "language")).alias("b")
    return s.groupBy("id").agg(best).select("id", "b.language", "b.score")


_SCRIPTS = [("ja", "[\\u3040-\\u30ff\\u4e00-\\u9fff]"), ("ko", "[\\uac00-\\ud7af\\u1100-\\u11ff]"), ("zh", "[\\u4e00-\\u9fff]"), ("ar", "[\\u0600-\\u06ff]"),
            ("he", "[\\u0590-\\u05ff]"), ("th", "[\\u0e00-\\u0e7f]"), ("el", "[\\u0370-\\u03ff]"), ("ru", "[\\u0400-\\u04ff]")]


def script_language(text: Column) -> Column:
    """The first script that makes more than 5 % of a text of 50 characters or more."""
    c = None
    for k, p in _SCRIPTS:
        hit = (F.length(text) - F.length(F.regexp_replace(text, p, ""))) > 0.05 * F.length(text)
        c = F.when(hit, F.lit(k)) if c is None else c.when(hit, F.lit(k))
    return F.when(F.length(text) >= 50, c)
