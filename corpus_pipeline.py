"""From raw documents to a weighted training mixture, as named stages over DataFrames.

Each stage takes (spark, docs, sf_dir), with ``docs`` all that its predecessor kept, and returns a DataFrame with the
columns of ``docs``; the last one returns the copies that the mixture takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm import decontaminate, jaccard_join, line_dedup, mixing, perplexity
from fieldloom.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the statistics and the perplexity bands accept."""
    return perplexity.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines found in ten or more of them; n_chars follows the text."""
    out = line_dedup.without_frequent_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the source weights ask for."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", drop_repeated_lines), ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks), ("mix_sources", mix_sources),
]

#: Perplexity models and embeddings have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
