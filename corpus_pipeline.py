"""The corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.llm import jaccard_join, packing, quality, secrets, suffix_dedup
from audience_lens.llm.common import saved, table


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has both."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go, those without a word among them; the others stay as they are."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, null ids last; exactly one row a group."""
    return jaccard_join.one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in repeated 200-byte strings go, and characters that lose some of theirs; every document stays, if need be
    with an empty text."""
    return _with_length(suffix_dedup.without_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null and empty texts as they are."""
    return _with_length(secrets.without_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024; a null or empty text is one piece that is the end id alone."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages),
          ("secret_scan", secret_scan), ("best_fit_packing", pack)]
#: The weighed rules iterate and the packing is greedy; neither is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
