"""Degradation monitoring of closed live trades, batch form (the streaming form keeps the same state)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.functions.staging import stage

# Alert limits.
PF_RATIO, WIN_RATE_RATIO, MAX_LOSS_STREAK, MIN_TRADES, ROLLING, ALERTS_BEFORE_RERUN = 0.70, 0.70, 8, 20, 30, 3
# Detector settings.
SHIFT, THRESHOLD = 0.15, 12.0
STALE_MINUTES = 45


def cusum_reference(p0: Column) -> Column:
    """Allowance k of the win-rate detector for a baseline win rate."""
    p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), p0.cast("double")))
    p1 = F.greatest(F.lit(0.01), F.least(p - 0.01, p * (1.0 - SHIFT)))
    den = F.ln((p * (1.0 - p1)) / (p1 * (1.0 - p)))
    return F.coalesce(F.try_divide(F.ln((1.0 - p1) / (1.0 - p)), den), F.lit(0.5))


def cusum_reference_value(p0: float) -> float:
    """The same for one plain number (streaming state update)."""
    p = max(0.05, min(0.95, p0))
    p1 = max(0.01, min(p - 0.01, p * (1.0 - SHIFT)))
    den = math.log((p * (1 - p1)) / (p1 * (1 - p)))
    return math.log((1 - p1) / (1 - p)) / den if den else 0.5


def rolling(numbered: DataFrame, keys: Sequence[str], n: int = ROLLING, seq: str = "trade_no", whole: bool = False) -> DataFrame:
    """Win rate, profit factor, net P&L and current loss streak over the last ``n`` trades. ``whole``: keys are taken whole."""
    rows = numbered.withColumns({"_chunk": F.lit(0), "_own": F.lit(True)}) if whole else ordered.spread(numbered, n, seq=seq)
    w = ordered.chunk_window(keys, seq).rowsBetween(-(n - 1), 0)
    p = F.col("net_pnl")
    rows = rows.withColumns({
        "_n": F.count(F.lit(1)).over(w), "_wins": F.sum((p > 0).cast("int")).over(w), "_gp": F.sum(F.when(p > 0, p).otherwise(0.0)).over(w),
        "_gl": F.abs(F.sum(F.when(p <= 0, p).otherwise(0.0)).over(w)), "rolling_net_pnl": F.sum(p).over(w),
        "_last_win": F.max(F.when(p > 0, F.col(seq))).over(w)})
    pf = F.when(F.col("_gl") > 0, F.try_divide(F.col("_gp"), F.col("_gl"))).when(F.col("_gp") > 0, F.lit(float("inf"))).otherwise(0.0)
    rows = rows.withColumns({"rolling_trades": F.col("_n"), "rolling_win_rate": F.col("_wins") / F.col("_n"), "rolling_pf": pf,
                             "loss_streak": F.coalesce(F.col(seq) - F.col("_last_win"), F.col("_n"))})
    return ordered.own_rows(rows).drop("_n", "_wins", "_gp", "_gl", "_last_win")


def degradation(numbered: DataFrame, baselines: DataFrame, keys: Sequence[str] = ("strategy_id",), seq: str = "trade_no",
                whole: bool = False) -> DataFrame:
    """Alerts, alert count, CUSUM score and status after every trade.

    ``baselines``: keys, wf_median_pf, wf_win_rate, p0. Both the alert counter (up on alert, down to
    zero otherwise) and the CUSUM score are walks reflected at zero: total minus its lowest value.
    """
    keys = list(keys)
    chunk = None if whole else F.floor((F.col(seq) - 1) / ordered.CHUNK_ROWS)
    r = rolling(numbered, keys, seq=seq, whole=whole).join(baselines, keys)
    c = F.col
    active = c("rolling_trades") >= MIN_TRADES
    alerts = F.array_compact(F.array(
        F.when((c("wf_median_pf") > 0) & (c("rolling_pf") < c("wf_median_pf") * PF_RATIO), F.lit("PF_DEGRADATION")),
        F.when(c("loss_streak") >= MAX_LOSS_STREAK, F.lit("CONSECUTIVE_LOSSES")),
        F.when((c("wf_win_rate") > 0) & (c("rolling_win_rate") < c("wf_win_rate") * WIN_RATE_RATIO), F.lit("WIN_RATE_DEGRADATION"))))
    r = r.withColumn("alerts", F.when(active, alerts).otherwise(F.array().cast("array<string>")))
    step = F.when(active, F.when(F.size("alerts") > 0, 1.0).otherwise(-1.0)).otherwise(0.0)
    r = r.withColumn("_a", step).withColumn("_k", cusum_reference(c("p0")) - (c("net_pnl") > 0).cast("int"))
    walk = ordered.running(r, keys, [seq], chunk, {
        "_alert": ("walk", c("_a")), "_cusum": ("walk", c("_k")), "max_loss_streak": ("max", c("loss_streak")),
        "wins": ("sum", (c("net_pnl") > 0).cast("int"))})
    walk = walk if whole else stage(walk)  # only chunks read their input twice
    walk = (walk.withColumn("alert_count", (c("_alert") - c("_alert_low")).cast("int"))
            .withColumn("cusum_score", c("_cusum") - c("_cusum_low")))
    fired = F.size("alerts") > 0
    level = F.when(fired, F.when(c("alert_count") >= ALERTS_BEFORE_RERUN, "DEGRADED").otherwise("WARNING")).when(
        (c("rolling_trades") >= MIN_TRADES) & (c("alert_count") == 0), "OK")
    rerun = F.when(fired & (c("alert_count") >= ALERTS_BEFORE_RERUN), True).when(
        ~fired & (c("rolling_trades") >= MIN_TRADES) & (c("alert_count") == 0), False)
    trip = (c(seq) >= MIN_TRADES) & (c("cusum_score") >= THRESHOLD)
    out = ordered.running(walk, keys, [seq], chunk, {
        "_status": ("last", level), "_rerun": ("last", rerun.cast("int")), "trip_no": ("min", F.when(trip, c(seq)))})
    return (out.withColumn("cusum_tripped", c("trip_no").isNotNull())
            .withColumn("status", F.when(c("cusum_tripped"), "DEGRADED").otherwise(F.coalesce("_status", F.lit("OK"))))
            .withColumn("rerun_recommended", c("cusum_tripped") | (F.coalesce("_rerun", F.lit(0)) == 1))
            .drop("_a", "_k", "_alert", "_alert_high", "_alert_low", "_cusum", "_cusum_high", "_cusum_low", "_status", "_rerun"))


def latest_summary(states: DataFrame, keys: Sequence[str] = ("strategy_id",), seq: str = "trade_no") -> DataFrame:
    """The last state of every key; combined before the shuffle, states are read once."""
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in states.columns if c not in keys]), F.col(seq)).alias("_s"))
    return last.select(*keys, "_s.*")


def stale(bars: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Age of the newest bar per symbol and whether it is too old."""
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("last_candle"))
    age = (F.unix_seconds(now) - F.unix_seconds("last_candle")) / 60.0
    return newest.withColumn("age_minutes", age).withColumn("stale", F.col("age_minutes") > minutes)


def newest(rows: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The ``cols`` of the newest row per key; combined before the shuffle."""
    top = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return top.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def system_status(latest: dict[str, DataFrame], key: str = "strategy_id") -> DataFrame:
    """One row per strategy from the newest row of each source (engine, degradation, performance, decision ...)."""
    out = None
    for name, df in latest.items():
        part = df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = part if out is None else out.join(part, key, "full_outer")
    return out
