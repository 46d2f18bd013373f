"""Performance metrics per group of trades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.functions.calendar import elapsed_years
from candlewick.operators.paths import equity_path

INF = float("inf")
METRICS = ["total_trades", "win_count", "loss_count", "win_rate", "gross_profit", "gross_loss", "net_profit",
           "profit_factor", "avg_win", "avg_loss", "avg_win_loss_ratio", "total_return_pct", "annualised_return_pct",
           "max_drawdown_usd", "max_drawdown_pct", "max_consecutive_losses", "ulcer_index", "calmar_ratio", "sharpe_ratio"]
# digits of the reported values
ROUNDING = {"win_rate": 4, "gross_profit": 2, "gross_loss": 2, "net_profit": 2, "profit_factor": 4, "avg_win": 2,
            "avg_loss": 2, "avg_win_loss_ratio": 4, "total_return_pct": 4, "annualised_return_pct": 4,
            "max_drawdown_usd": 2, "max_drawdown_pct": 4, "ulcer_index": 4, "calmar_ratio": 4, "sharpe_ratio": 4}


def ratio_or_inf(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(INF))


def pnl_aggregates(pnl: str = "net_pnl") -> list[Column]:
    p = F.col(pnl)
    win = p > 0
    return [F.count(F.lit(1)).alias("total_trades"), F.count_if(win).alias("win_count"),
            F.count_if(~win).alias("loss_count"),
            F.coalesce(F.sum(F.when(win, p)), F.lit(0.0)).alias("gross_profit"),
            F.abs(F.coalesce(F.sum(F.when(~win, p)), F.lit(0.0))).alias("gross_loss"),
            F.sum(p).alias("net_profit"),
            F.coalesce(F.avg(F.when(win, p)), F.lit(0.0)).alias("avg_win"),
            F.abs(F.coalesce(F.avg(F.when(~win, p)), F.lit(0.0))).alias("avg_loss"),
            F.avg(p).alias("_mean"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("_std")]


def pnl_ratios(df: DataFrame) -> DataFrame:
    return (df.withColumn("win_rate", F.col("win_count") / F.col("total_trades"))
            .withColumn("profit_factor", ratio_or_inf(F.col("gross_profit"), F.col("gross_loss")))
            .withColumn("avg_win_loss_ratio", ratio_or_inf(F.col("avg_win"), F.col("avg_loss"))))


def summary(trades: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None, initial_equity: float,
            window: tuple[str, str] | None = None, more: Mapping[str, Column] | None = None) -> DataFrame:
    """All metrics per key. ``window`` names the columns bounding the evaluated period; without it the
    period runs from the first entry to the last exit. A period that ends before it starts is an error.
    ``more`` adds aggregates of the trades.
    """
    lo, hi = (F.min("entry_time"), F.max("exit_time")) if window is None else (F.min(window[0]), F.max(window[1]))
    sums = [*pnl_aggregates(), lo.alias("_lo"), hi.alias("_hi"), *[c.alias(n) for n, c in (more or {}).items()]]
    found = (_whole if chunk is None else _in_chunks)(trades, keys, order, chunk, initial_equity, sums)
    return ratios(pnl_ratios(found), initial_equity).select(*keys, *METRICS, *(more or {}))


def _whole(trades: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: None, initial_equity: float, sums: Sequence[Column]) -> DataFrame:
    """Sums and risk of whole keys from one pass over their sorted trades: nothing is shuffled or joined after them."""
    p = F.col("net_pnl")
    known = trades.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))  # as the join of the chunks has it
    path = equity_path(known, keys, order, chunk, initial_equity, extra={"_lost": ("sum", (p <= 0).cast("int"))})
    path = ordered.running(path, keys, order, chunk, {"_at_win": ("max", F.when(p > 0, F.col("_lost")))})
    dd_pct = F.try_divide(F.col("drawdown") * 100, F.col("peak_equity"))
    return path.groupBy(*keys).agg(
        *sums, F.max(F.col("_lost") - F.coalesce("_at_win", F.lit(0))).alias("max_consecutive_losses"),
        F.max("drawdown").alias("max_drawdown_usd"), F.sqrt(F.sum(dd_pct * dd_pct) / (F.count(F.lit(1)) + 1)).alias("ulcer_index"))


def _in_chunks(trades: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, initial_equity: float, sums: Sequence[Column]) -> DataFrame:
    base = trades.groupBy(*keys).agg(*sums)
    path = equity_path(trades, keys, order, chunk, initial_equity,
                       extra={"_wins": ("sum", (F.col("net_pnl") > 0).cast("int"))})
    dd_pct = F.try_divide(F.col("drawdown") * 100, F.col("peak_equity"))
    # a run of losses is the set of losing trades sharing one count of wins
    runs = path.groupBy(*keys, "_wins").agg(
        F.count_if(F.col("net_pnl") <= 0).alias("_losses"), F.max("drawdown").alias("_dd"),
        F.sum(dd_pct * dd_pct).alias("_sq"), F.count(F.lit(1)).alias("_n"))
    risk = runs.groupBy(*keys).agg(
        F.max("_losses").alias("max_consecutive_losses"), F.max("_dd").alias("max_drawdown_usd"),
        F.sqrt(F.sum("_sq") / (F.sum("_n") + 1)).alias("ulcer_index"))
    return base.join(risk, list(keys))


def ratios(df: DataFrame, initial_equity: float) -> DataFrame:
    """Returns and risk-adjusted ratios from the sums (needs _lo, _hi, _mean, _std)."""
    start = F.lit(float(initial_equity))
    span = F.when(F.col("_hi") < F.col("_lo"), F.raise_error(F.lit("evaluation period ends before it starts"))).otherwise(
        elapsed_years(F.col("_lo"), F.col("_hi")))
    growth = F.lit(1.0) + F.col("total_return_pct") / 100
    return (df.withColumn("_years", span)
            .withColumn("max_drawdown_pct", F.col("max_drawdown_usd") / start * 100)
            .withColumn("total_return_pct", F.col("net_profit") / start * 100)
            .withColumn("annualised_return_pct", F.when(growth > 0, (F.pow(growth, 1 / F.col("_years")) - 1) * 100))
            .withColumn("calmar_ratio", ratio_or_inf(F.col("annualised_return_pct"), F.col("max_drawdown_pct")))
            .withColumn("sharpe_ratio", F.when((F.col("total_trades") < 2) | (F.col("_std") == 0), F.lit(0.0)).otherwise(
                F.try_divide(F.col("_mean"), F.col("_std")) * F.sqrt(F.col("total_trades") / F.col("_years")))))


def with_zero_rows(keys_df: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key gets a row; zero metrics where there were no trades."""
    return keys_df.select(*keys).distinct().join(metrics, list(keys), "left").fillna(0, METRICS)


def rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({c: F.round(c, n) for c, n in ROUNDING.items() if c in metrics.columns})


def recent_performance(numbered: DataFrame, keys: Sequence[str], n: int = 50, seq: str = "trade_no") -> DataFrame:
    """Status-panel numbers of the last ``n`` trades per key; a loss here is strictly negative."""
    top = numbered.groupBy(*keys).agg(F.max(seq).alias("_top"))
    p = F.col("net_pnl")
    last = numbered.join(top, list(keys)).filter(F.col(seq) > F.col("_top") - n)
    return (last.groupBy(*keys).agg(F.count(F.lit(1)).alias("recent_trades"), F.count_if(p > 0).alias("_wins"),
                                    F.sum(p).alias("total_pnl"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("_gp"),
                                    F.abs(F.sum(F.when(p < 0, p).otherwise(0.0))).alias("_gl"))
            .withColumn("win_rate", F.col("_wins") / F.col("recent_trades"))
            .withColumn("profit_factor", F.when(F.col("_gl") > 0, F.try_divide(F.col("_gp"), F.col("_gl"))).otherwise(0.0))
            .select(*keys, "recent_trades", "win_rate", "total_pnl", "profit_factor"))


def breakdown(trades: DataFrame, by: Sequence[str], mode: str = "group") -> DataFrame:
    """P&L metrics by context columns; ``mode`` is group, cube or rollup."""
    grouped = {"group": trades.groupBy, "cube": trades.cube, "rollup": trades.rollup}[mode](*by)
    extra = [] if mode == "group" else [F.grouping_id(*by).alias("grouping_id")]
    return pnl_ratios(grouped.agg(*pnl_aggregates(), *extra)).drop("_mean", "_std")
