"""Registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.staging import stage
from candlewick.llm import (
    chat, decontaminate, exact_dedup, filter_audit, language_model, mixing, near_duplicates, pii, quality, sql, suffix_dedup, token_counts, warc, whitening,
)
from candlewick.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if twin is not None:
            ORACLES[name] = twin
        return fn

    return add


@query("op1_benchmark_decontamination", sql.DECONTAMINATION)
def op1(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), locate=False)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["behind"] - h["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op2_chat_formatting", sql.CHAT)
def op2(spark, sf_dir):
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    return language_model.scores(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op5_suffix_array_dedup")
def op5(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op6_quality_rules", sql.QUALITY)
def op6(spark, sf_dir):
    book = quality.verdicts(stage(quality.ledger(table(spark, sf_dir, "documents"))))  # the stored ledger serves every policy and the ablations
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask(*quality.BASE)).cast("bigint")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.col(f"kept_{quality.CURRENT}").alias("kept"),
                       "fail_bits", "kept_v1", "only_rule", "only_rule_docs")


@query("op7_mixing")
def op7(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_warc", sql.WARC)
def op8(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages")).drop("header")


@query("op9_minhash_near_dedup", sql.NEAR_DUPLICATES)
def op9(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_personal_data")
def op10(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query("op11_exact_dedup", sql.EXACT_DUPLICATES)
def op11(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op12_filter_interactions", sql.FILTER_AUDIT)
def op12(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
