"""A training corpus from documents: quality rules, near duplicates, decontamination, personal data, source mix.

Every stage is a function of (spark, docs, sf_dir) over all rows its predecessor kept; ``run`` writes each result to the
shared folder and reads it again for the next one. All but the last return the columns of ``documents``; the last
returns one row for each document that the mix takes words from.

Defined cases, by stage: null and empty texts fail the rules and go; of rows that repeat doc_id and text one stays, of texts
under one doc_id each is judged by itself, rows with a null doc_id stay; a null item holds no window; texts without personal
data stay as they are, null texts stay null; a null source is a source of its own. Empty tables stay empty. Further columns
are kept up to the mix, which returns those of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.functions.staging import stage
from candlewick.llm import decontaminate, mixing, near_duplicates, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the current policy accepts."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates."""
    return near_duplicates.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents in which a window of a benchmark item occurs."""
    return decontaminate.remove_affected(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; every document stays."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its schedule: documents by the first slot that takes words of them, with the words taken (repeats
    counted); those it does not take are left out."""
    return mixing.mix(docs, carry=("text", "lang", "source", "n_chars")).where("taken > 0").orderBy("first_slot", "doc_id")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("mix_sources", mix_sources)]

# Redaction scores by context and the low-discrepancy schedule have no SQL form; tests compare with a loop instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
