"""Quick score, walk-forward summary, hard gates, composite score, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hard gate limits.
GATES = {
    "min_total_trades": 100, "min_trades_per_window": 20, "min_valid_windows": 12, "max_median_drawdown_pct": 20.0,
    "min_median_profit_factor": 1.1, "min_profitable_window_rate": 0.55, "max_consecutive_losses": 10,
    "min_regime_windows": 3, "max_monte_carlo_breach_rate": 3.0,
}
# Composite score weights and modifiers.
WEIGHTS = {"calmar": 0.40, "profit_factor": 0.25, "win_loss_ratio": 0.15, "regime": 0.10, "stability": 0.05, "robustness": 0.05}
FRAGILE_PENALTY, ROBUST_BONUS = 0.10, 0.05
# Quick score weights.
QUICK = {"calmar": 0.25, "profit_factor": 0.20, "sharpe": 0.15, "win_rate": 0.15, "expectancy": 0.15, "headroom": 0.10}


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(x, F.lit(hi)))


def quick_score(min_trades: int = 10, max_dd_pct: float = 8.0, allow_partial: bool = False,
                compliant: Column | None = None, expectancy_pips: Column | None = None) -> Column:
    """Score in [0, 1] over metric columns (profit_factor, calmar_ratio, ...); 0 for unusable rows."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    n, pf, dd = z("total_trades"), z("profit_factor"), z("max_drawdown_pct")
    per_trade = clip(F.try_divide(z("net_profit"), n) / 100.0, 0, 1)
    exp = per_trade if expectancy_pips is None else F.coalesce(clip(expectancy_pips / 20.0, 0, 1), per_trade)
    wr = F.when(z("win_rate") > 1.0, z("win_rate") / 100.0).otherwise(z("win_rate"))
    limit = max_dd_pct if max_dd_pct > 0 else 8.0
    raw = (clip(z("calmar_ratio"), 0, 3) / 3.0 * QUICK["calmar"] + clip((pf - 1.0) / 2.0, 0, 1) * QUICK["profit_factor"]
           + clip(z("sharpe_ratio"), 0, 3) / 3.0 * QUICK["sharpe"] + clip(wr, 0, 1) * QUICK["win_rate"]
           + exp * QUICK["expectancy"] + clip(1.0 - dd / limit, 0, 1) * QUICK["headroom"])
    ramp = F.when(n < min_trades, F.pow(n / float(max(1, min_trades)), 1.5) if allow_partial else F.lit(0.0)).otherwise(F.lit(1.0))
    zero = (n <= 0) | (pf <= 1.0) | ((dd > max_dd_pct) if max_dd_pct > 0 else F.lit(False))
    if compliant is not None:
        zero = zero | F.coalesce(~compliant, F.lit(False))
    return F.when(zero, F.lit(0.0)).otherwise(F.round(clip(raw * ramp, 0, 1), 6))


def aggregate_windows(results: DataFrame, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """One summary row per candidate from its window results; only windows with status OK count.

    A column ``new_trading_days`` (trading days that no other window of the candidate counts), if there is one, is summed over all
    windows as ``trading_days``. Medians are exact. Early and recent thirds are told apart by the window's rank; windows per
    candidate are few (months of history over months per window).
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("window_num")
    valid = F.coalesce(F.col("status") == "OK", F.lit(False))
    values = ["oos_trades", "oos_profit_factor", "oos_win_rate", "oos_calmar", "oos_max_drawdown", "oos_max_consec_losses", "oos_net_profit",
              "oos_composite_score", "oos_mandate_compliant", "oos_mandate_breach_reason"]
    # windows that do not count have a row of NULLs, so candidates without a valid one are told in the same pass
    ok = (results.withColumn("_ok", valid).withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in values})
          .withColumn("_rank", F.when(F.col("_ok"), F.count_if("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0))))
          .withColumn("_n", F.count_if("_ok").over(Window.partitionBy(*keys))))
    third = F.floor(F.col("_n") / 3)
    wr, pf = F.col("oos_win_rate"), F.col("oos_profit_factor")
    wl = F.when((wr > 0) & (wr < 1) & (pf > 0), pf * (1 - wr) / wr)
    med = lambda c: F.coalesce(F.percentile(c, 0.5), F.lit(0.0))
    bad = ~F.coalesce(F.col("oos_mandate_compliant"), F.lit(True))
    days = [F.sum("new_trading_days").alias("trading_days")] if "new_trading_days" in results.columns else []
    s = ok.groupBy(*keys).agg(
        F.count_if("_ok").alias("valid_windows"), F.sum("oos_trades").alias("total_trades"),
        med("oos_trades").alias("median_trades_per_window"), med(F.when(pf > 0, pf)).alias("median_profit_factor"),
        med("oos_win_rate").alias("median_win_rate"), med("oos_calmar").alias("median_calmar_ratio"), med(wl).alias("median_avg_win_loss"),
        med("oos_max_drawdown").alias("median_max_drawdown_pct"), F.max("oos_max_drawdown").alias("worst_oos_drawdown_pct"),
        F.try_divide(F.count_if(F.col("oos_net_profit") > 0), F.count_if("_ok")).alias("profitable_window_rate"),
        F.max("oos_max_consec_losses").alias("max_consecutive_losses"),
        F.avg(F.when(F.col("_rank") <= third, F.col("oos_composite_score"))).alias("_early"),
        F.avg(F.when(F.col("_rank") > F.col("_n") - third, F.col("oos_composite_score"))).alias("_recent"),
        F.sum("oos_net_profit").alias("total_oos_pnl"), F.avg("oos_net_profit").alias("avg_oos_pnl_per_window"),
        (~F.bool_or(bad)).alias("mandate_compliant"),
        F.min_by("oos_mandate_breach_reason", F.when(bad, F.col("window_num"))).alias("mandate_breach_reason"), *days)
    trend = F.when(F.col("valid_windows") < 3, F.lit(0.0)).otherwise(
        F.when(F.col("_early") > 0, (F.col("_recent") - F.col("_early")) / F.col("_early") * 100).otherwise(F.lit(0.0)))
    s = (s.withColumn("temporal_trend_pct", trend)
         .withColumn("temporal_stable", (F.col("valid_windows") < 3) | (F.abs("temporal_trend_pct") < 30))
         .withColumn("regime_consistency", F.col("profitable_window_rate")).drop("_early", "_recent"))
    some = F.col("valid_windows") > 0
    for k in keys:
        some = some & F.col(k).isNotNull()
    kept = {*keys, "trading_days"}
    return s.select(*[F.col(c) if c in kept else F.when(some, F.col(c)).alias(c) for c in s.columns]).fillna(EMPTY_SUMMARY)


# The summary of a candidate without a single valid window.
EMPTY_SUMMARY = {
    "valid_windows": 0, "total_trades": 0, "median_trades_per_window": 0.0, "median_profit_factor": 0.0, "median_calmar_ratio": 0.0,
    "median_avg_win_loss": 0.0, "median_max_drawdown_pct": 100.0, "profitable_window_rate": 0.0, "max_consecutive_losses": 99,
    "regime_consistency": 0.0, "temporal_stable": False, "temporal_trend_pct": -100.0, "mandate_compliant": True,
}


def hard_gates(summary: DataFrame, mandate: dict) -> DataFrame:
    """All ten gates in order as an array of structs, with the verdict and the first failure.

    Besides the summary columns it reads, where present: risk_per_trade_pct, max_trade_risk_pct,
    trading_days, oos_trade_rows and breach_rate_pct (stress test). Gate 8 only informs. The stress
    columns may be NULL for candidates that failed earlier, so the costly test can run for survivors.
    """
    has = set(summary.columns)
    c = lambda n, alt=None: F.col(n) if n in has else F.lit(alt)
    cap, days = float(mandate["max_daily_risk_pct"]), int(mandate["min_trading_days"])
    risk_ok = ((F.coalesce(c("risk_per_trade_pct").cast("double"), F.lit(0.0)) <= cap)
               & (F.coalesce(c("max_trade_risk_pct").cast("double"), F.lit(0.0)) <= cap))
    days_ok = F.coalesce(c("trading_days").cast("bigint"), F.lit(days)) >= days
    stress = c("breach_rate_pct").cast("double")
    rows = [
        ("gate_1_total_trades", c("total_trades"), GATES["min_total_trades"], c("total_trades") >= GATES["min_total_trades"], True),
        ("gate_2_trades_per_window", c("median_trades_per_window"), GATES["min_trades_per_window"], c("median_trades_per_window") >= GATES["min_trades_per_window"], True),
        ("gate_3_valid_windows", c("valid_windows"), GATES["min_valid_windows"], c("valid_windows") >= GATES["min_valid_windows"], True),
        ("gate_4_max_drawdown", c("median_max_drawdown_pct"), GATES["max_median_drawdown_pct"], c("median_max_drawdown_pct") <= GATES["max_median_drawdown_pct"], True),
        ("gate_5_profit_factor", c("median_profit_factor"), GATES["min_median_profit_factor"], c("median_profit_factor") >= GATES["min_median_profit_factor"], True),
        ("gate_6_profitable_windows", c("profitable_window_rate"), GATES["min_profitable_window_rate"], c("profitable_window_rate") >= GATES["min_profitable_window_rate"], True),
        ("gate_7_consecutive_losses", c("max_consecutive_losses"), GATES["max_consecutive_losses"], c("max_consecutive_losses") <= GATES["max_consecutive_losses"], True),
        ("gate_8_regime_coverage", c("regime_windows_min", 0), GATES["min_regime_windows"], c("regime_windows_min", 0) >= GATES["min_regime_windows"], False),
        ("gate_9_mandate_compliance", c("mandate_compliant").cast("int"), 1, F.coalesce(c("mandate_compliant"), F.lit(True)), True),
        ("gate_10_data", c("oos_trade_rows", 1), 1, F.coalesce(c("oos_trade_rows", 1), F.lit(0)) > 0, True),
        ("gate_9_mandate_compliance", c("trading_days"), days, risk_ok & days_ok, True),
        ("gate_10_monte_carlo_stress", stress, GATES["max_monte_carlo_breach_rate"], F.coalesce(stress <= GATES["max_monte_carlo_breach_rate"], F.lit(True)), True),
    ]
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), v.cast("double").alias("value"), F.lit(float(t)).alias("threshold"),
                               F.coalesce(ok, F.lit(False)).alias("passed"), F.lit(hard).alias("enforced")) for g, v, t, ok, hard in rows])
    failed = F.get(F.filter("gates", lambda g: g["enforced"] & ~g["passed"]), F.lit(0))
    out = summary.withColumn("gates", gates).withColumn("_f", failed)
    name = F.when(F.col("_f.gate") == "gate_10_data", "gate_10_monte_carlo_stress").otherwise(F.col("_f.gate"))
    return (out.withColumn("gates_passed", F.col("_f").isNull()).withColumn("failed_gate", name)
            .withColumn("failure_reason", F.when(F.col("_f").isNotNull(), F.when(
                F.col("_f.gate") == "gate_10_data", "GATE_10_ZERO_TRADES").otherwise(
                F.concat(name, F.lit(": "), F.coalesce(F.round("_f.value", 3).cast("string"), F.lit("NULL")), F.lit(" vs limit "),
                         F.col("_f.threshold").cast("string"))))).drop("_f"))


def with_stress(gated: DataFrame, stress: DataFrame, mandate: dict, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """Add stress results (computed for survivors only) and evaluate the gates again."""
    return hard_gates(gated.drop("gates", "gates_passed", "failed_gate", "failure_reason").join(stress, list(keys), "left"), mandate)


def gate_table(gated: DataFrame, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """One row per candidate and gate."""
    return gated.select(*keys, F.posexplode("gates").alias("gate_no", "_g")).select(
        *keys, (F.col("gate_no") + 1).alias("gate_no"), "_g.gate", "_g.value", "_g.threshold", "_g.passed")


def composite_score(summary: DataFrame, trial_count: Column | int, max_dd_pct: float = 8.0) -> DataFrame:
    """Weighted score with sensitivity modifier, multiple-testing deflation and near-limit penalty.

    Optional columns: tier2_robustness, sensitivity_status. ``trial_count`` below 1 fails the job.
    """
    has = set(summary.columns)
    trials = F.lit(trial_count) if isinstance(trial_count, int) else trial_count
    trials = F.when(trials < 1, F.raise_error(F.lit("trial_count must be >= 1")).cast("bigint")).otherwise(trials)
    tier2 = F.col("tier2_robustness") if "tier2_robustness" in has else F.lit(None).cast("double")
    sens = F.coalesce(F.col("sensitivity_status"), F.lit("MODERATE")) if "sensitivity_status" in has else F.lit("MODERATE")
    third = lambda c: clip(F.col(c), 0, 3) / 3.0
    stable, trend = F.col("temporal_stable"), F.col("temporal_trend_pct")
    stability = (F.when(stable & (trend > -10), 1.0).when(stable, 0.7).when(trend > 0, 0.6).when(trend <= -20, 0.2).otherwise(0.4))
    robust = F.when(tier2.isNull(), 0.5).when(tier2 >= 0.70, 1.0).when(tier2 >= 0.40, 0.6).otherwise(0.2)
    dims = {"calmar": third("median_calmar_ratio"), "profit_factor": third("median_profit_factor"),
            "win_loss_ratio": third("median_avg_win_loss"), "regime": clip(F.col("regime_consistency"), 0, 1),
            "stability": stability, "robustness": robust}
    floor = 0.85 * max_dd_pct
    worst = F.col("worst_oos_drawdown_pct").cast("double")
    near = F.when(worst > floor, F.round(F.least(F.lit(1.0), (worst - floor) / (max_dd_pct - floor)) * 0.10, 4)).otherwise(0.0) \
        if max_dd_pct > floor else F.lit(0.0)
    out = summary.withColumns({f"{k}_score": v.cast("double") for k, v in dims.items()})
    raw = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = (out.withColumn("raw_score", raw)
           .withColumn("sensitivity_mod", F.when(sens == "FRAGILE", F.col("raw_score") * -FRAGILE_PENALTY)
                       .when(sens == "ROBUST", F.col("raw_score") * ROBUST_BONUS).otherwise(0.0))
           .withColumn("deflation_penalty", F.round(F.least(F.lit(0.20), F.log10(trials) * 0.04), 4))
           .withColumn("prop_firm_penalty", near))
    final = F.col("raw_score") + F.col("sensitivity_mod") - F.col("deflation_penalty") - F.col("prop_firm_penalty")
    return out.withColumn("composite", F.round(clip(final, 0, 1), 4))


def interpretation(score: Column) -> Column:
    return F.when(score >= 0.70, "EXCELLENT").when(score >= 0.55, "GOOD").when(score >= 0.40, "MARGINAL").otherwise("WEAK")


def rank_candidates(scored: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Competition rank by score, computed from counts per distinct score (scores have four decimals)."""
    per = scored.groupBy(*within, "composite").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*within).orderBy(F.desc("composite")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select(*within, "composite", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("rank"))
    return scored.join(ranks, [*within, "composite"])


def degradation_verdict(results: DataFrame, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """In-sample against out-of-sample; the median here is the upper one."""
    ok = results.filter("status = 'OK'")
    pf = F.when(F.col("oos_profit_factor") > 0, F.col("oos_profit_factor"))
    a = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_windows"), (F.count_if(F.col("oos_net_profit") > 0) * 100.0 / F.count(F.lit(1))).alias("profitable_pct"),
        F.sort_array(F.collect_list(pf)).alias("_pf"), F.sum("oos_net_profit").alias("total_oos_pnl"),
        F.avg("oos_net_profit").alias("avg_oos_pnl"), F.avg("is_composite_score").alias("avg_is"), F.avg("oos_composite_score").alias("avg_oos"))
    a = a.withColumn("median_pf", F.coalesce(F.get("_pf", F.floor(F.size("_pf") / 2).cast("int")), F.lit(0.0))).drop("_pf")
    p, m = F.col("profitable_pct"), F.col("median_pf")
    return (a.withColumn("degradation_pct", F.when(F.col("avg_is") > 0, (F.col("avg_oos") - F.col("avg_is")) / F.col("avg_is") * 100))
            .withColumn("verdict", F.when((p >= 60) & (m >= 1.1), "PROMISING").when((p >= 50) & (m >= 1.0), "MARGINAL")
                        .when(p >= 40, "WEAK").otherwise("NO EDGE")))


def skipped_windows(results: DataFrame, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    return results.filter("status <> 'OK'").groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("windows"))
