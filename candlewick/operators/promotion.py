"""Promotion decisions, bench lifecycle, run summaries and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision thresholds.
AUTO_PROMOTE, FIRST_RUN_AUTO, FIRST_RUN_FLAG = 0.20, 0.50, 0.40
MIN_CALMAR, MIN_PF, MAX_DD, MIN_PROFITABLE, MIN_REGIME = 1.0, 1.3, 18.0, 0.65, 0.60


def improvement_pct(score: Column, baseline: Column) -> Column:
    """Percent over the baseline; NULL without one."""
    return F.try_divide((score - baseline) * 100, baseline)


def condition_failures() -> Column:
    """Array of auto-promote conditions a summary row misses."""
    c = F.col
    checks = [("CALMAR", c("median_calmar_ratio") < MIN_CALMAR), ("PROFIT_FACTOR", c("median_profit_factor") < MIN_PF),
              ("DRAWDOWN", c("median_max_drawdown_pct") > MAX_DD), ("PROFITABLE_WINDOWS", c("profitable_window_rate") < MIN_PROFITABLE),
              ("REGIME_CONSISTENCY", c("regime_consistency") < MIN_REGIME), ("FRAGILE", c("sensitivity_status") == "FRAGILE")]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


def decide(scored: DataFrame) -> DataFrame:
    """Decision path, outcome and flags per candidate.

    Needs composite, baseline_score, gates_passed, failure_reason and the summary columns. A zero
    baseline with ``first_run`` true is the first run.
    """
    c = F.col
    base = (scored.withColumn("improvement_pct", F.when(c("first_run") & c("gates_passed"), F.lit(None).cast("double")).otherwise(
                improvement_pct(c("composite"), c("baseline_score"))))
            .withColumn("_fail", condition_failures()))
    big = c("improvement_pct") >= AUTO_PROMOTE * 100
    path = (F.when(~c("gates_passed"), "AUTO_REJECT")
            .when(c("first_run") & (c("composite") >= FIRST_RUN_AUTO), "AUTO_PROMOTE")
            .when(c("first_run") & (c("composite") >= FIRST_RUN_FLAG), "FLAG_REVIEW").when(c("first_run"), "AUTO_REJECT")
            .when(c("improvement_pct").isNull() | (c("improvement_pct") < 0), "AUTO_REJECT")
            .when(big & (F.size("_fail") == 0), "AUTO_PROMOTE").otherwise("FLAG_REVIEW"))
    none = F.array().cast("array<string>")
    flags = (F.when(~c("gates_passed"), F.array(F.concat(F.lit("Gate failed: "), F.coalesce(c("failure_reason"), F.lit("?")))))
             .when(c("first_run"), F.when(c("decision_path") == "FLAG_REVIEW", F.array(F.lit("First run"))).otherwise(none))
             .when(c("decision_path") == "AUTO_REJECT", F.array(F.lit("Does not beat baseline")))
             .when(c("decision_path") == "AUTO_PROMOTE", none)
             .otherwise(F.concat(F.when(~big, F.array(F.lit("Improvement below threshold"))).otherwise(none), c("_fail"))))
    outcome = F.when(c("decision_path") == "AUTO_PROMOTE", "PROMOTED").when(c("decision_path") == "FLAG_REVIEW", "FLAGGED").otherwise("REJECTED")
    return (base.withColumn("decision_path", path).withColumn("decision_outcome", outcome).withColumn("flags", flags)
            .withColumn("strategy_deployed", c("decision_outcome") == "PROMOTED").drop("_fail"))


def decision_records(decisions: DataFrame, run_id: Column) -> DataFrame:
    """Rows for the append-only decision log."""
    return decisions.withColumn("run_id", run_id).withColumn(
        "decision_id", F.substring(F.sha2(F.concat_ws("_", "run_id", "candidate_id"), 256), 1, 12))


def parameter_diff(active: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parameters (key columns, ``parameters`` map) side by side; missing values show as a dash."""
    long = lambda df, name: df.select(*keys, F.explode("parameters").alias("parameter", name))
    both = long(active, "active_value").join(long(candidate, "candidate_value"), [*keys, "parameter"], "full_outer")
    return (both.withColumns({c: F.coalesce(c, F.lit("—")) for c in ("active_value", "candidate_value")})
            .withColumn("changed", F.col("active_value") != F.col("candidate_value")))


def upsert(bench: DataFrame, changes: DataFrame, key: str = "strategy_id") -> DataFrame:
    """New rows are added; a changed row keeps the old value wherever the change has NULL."""
    other = [c for c in bench.columns if c != key]
    b, n = bench.alias("b"), changes.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")).alias(c) if c in changes.columns else F.col(f"b.{c}").alias(c) for c in other]
    return b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"b.{key}")).alias(key), *cols)


def deploy(bench: DataFrame, strategy_id: Column | str, at: Column) -> DataFrame:
    """Mark one strategy DEPLOYED and the previously deployed ones ARCHIVED (needs status, deployed_at, archived_at)."""
    this = F.col("strategy_id") == strategy_id
    old = (F.col("status") == "DEPLOYED") & ~this
    return (bench.withColumn("archived_at", F.when(old, at).otherwise(F.col("archived_at")))
            .withColumn("deployed_at", F.when(this, at).otherwise(F.col("deployed_at")))
            .withColumn("status", F.when(this, "DEPLOYED").when(old, "ARCHIVED").otherwise(F.col("status"))))


def by_status(bench: DataFrame, status: str) -> DataFrame:
    return bench.filter(F.col("status") == status.upper())


def by_id(bench: DataFrame, strategy_id: str) -> DataFrame:
    return bench.filter(F.col("strategy_id") == strategy_id)


def run_summary(decisions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Counts and best score per run; outcome from how many of its symbols failed (run_id, symbol, failed)."""
    d = decisions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidates_tested"), F.count_if(F.col("decision_outcome") == "PROMOTED").alias("candidates_promoted"),
        F.count_if(F.col("decision_outcome") == "FLAGGED").alias("candidates_flagged"),
        F.count_if(F.col("decision_outcome") == "REJECTED").alias("candidates_rejected"),
        F.max("composite").alias("best_score"), F.max("baseline_score").alias("baseline_score"),
        F.max_by("candidate_id", F.when(F.col("decision_outcome") == "PROMOTED", F.struct("composite", "candidate_id"))).alias("deployed_strategy_id"))
    s = symbols.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("failed").alias("_failed"))
    return (s.join(d, "run_id", "left").fillna(0, ["candidates_tested", "candidates_promoted", "candidates_flagged", "candidates_rejected"])
            .withColumn("outcome", F.when(F.col("_failed") == F.col("_n"), "FAILED").when(F.col("_failed") > 0, "PARTIAL_FAILURE").otherwise("COMPLETED"))
            .withColumn("improvement_pct", improvement_pct(F.col("best_score"), F.col("baseline_score")))
            .drop("_n", "_failed"))


def report_tables(decisions: DataFrame, layers: DataFrame) -> dict[str, DataFrame]:
    """The three report tables: candidates, decisions, layer trace (run_id, layer, status, detail)."""
    return {
        "candidates": decisions.select("run_id", "candidate_id", "template", F.when(F.col("gates_passed"), "PASSED").otherwise("FAILED").alias("gate_status"),
                                       F.col("composite").alias("composite_score")),
        "decisions": decisions.select("run_id", "candidate_id", "decision_outcome", "improvement_pct", F.array_join("flags", "; ").alias("reasoning")),
        "layers": layers.select("run_id", "layer", "status", "detail"),
    }
