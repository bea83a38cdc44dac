"""From raw documents to tokens: quality rules, near duplicates, benchmark leaks, personal data, BPE. Each stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read again as the
next one's docs. All but the last return the columns of documents, whatever others a table has besides. SQL can't express the stages;
tests hold them against brute force. Every stage takes an empty table, texts of any length, repeated rows and nulls in any column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bpe import bpe_encode
from weftline.llm.common import table, written
from weftline.llm.decontam import decontaminate
from weftline.llm.jaccard_join import near_dedup
from weftline.llm.pii import redacted
from weftline.llm.quality_kn import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside their language's perplexity band go, and null, empty and blank texts. Repeated rows are judged each, a null language as one of its own."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays (repeated, if its row is). Wordless texts and null ids stay."""
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null texts stay; items of null text hold nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become [KIND], and n_chars the new length. Null texts stay null, repeated rows are redacted each."""
    return redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds tokens and n_tokens: null for a null text, none for an empty one; repeated rows are encoded each."""
    return bpe_encode(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_decontamination", benchmark_decontamination), ("pii", personal_data), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
