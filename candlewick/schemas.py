"""Table schemas and the plan-time column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

OHLCV = ("open", "high", "low", "close", "volume")

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("timeframe", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("spread", T.DoubleType()),
])

INSTRUMENT = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("digits", T.IntegerType()),
    T.StructField("point", T.DoubleType()),
    T.StructField("contract_size", T.DoubleType()),
    T.StructField("tick_size", T.DoubleType()),
    T.StructField("tick_value", T.DoubleType()),
    T.StructField("volume_min", T.DoubleType()),
    T.StructField("volume_step", T.DoubleType()),
    T.StructField("volume_max", T.DoubleType()),
    T.StructField("stops_level", T.IntegerType()),
    T.StructField("spread_typical", T.IntegerType()),
    T.StructField("swap_long", T.DoubleType()),
    T.StructField("swap_short", T.DoubleType()),
])

MANDATE = T.StructType([
    T.StructField("mandate_id", T.StringType()),
    T.StructField("firm_name", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("max_daily_loss_pct", T.DoubleType()),
    T.StructField("max_overall_drawdown_pct", T.DoubleType()),
    T.StructField("drawdown_type", T.StringType()),
    T.StructField("min_trading_days", T.IntegerType()),
    T.StructField("max_daily_risk_pct", T.DoubleType()),
    T.StructField("symbol_universe", T.ArrayType(T.StringType())),
    T.StructField("prohibited_patterns", T.ArrayType(T.StringType())),
])

LIVE_TRADE = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("trade_id", T.StringType()),
    T.StructField("strategy_id", T.StringType()),
    T.StructField("run_timestamp", T.StringType()),
    T.StructField("candle_time", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("timeframe", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("entry_price", T.DoubleType()),
    T.StructField("entry_time", T.StringType()),
    T.StructField("exit_price", T.DoubleType()),
    T.StructField("exit_time", T.StringType()),
    T.StructField("lots", T.DoubleType()),
    T.StructField("gross_pnl", T.DoubleType()),
    T.StructField("net_pnl", T.DoubleType()),
    T.StructField("commission", T.DoubleType()),
    T.StructField("spread_cost", T.DoubleType()),
    T.StructField("close_reason", T.StringType()),
    T.StructField("entry_session", T.StringType()),
    T.StructField("entry_regime", T.StringType()),
    T.StructField("entry_atr", T.DoubleType()),
    T.StructField("entry_adx", T.DoubleType()),
    T.StructField("entry_spread_pips", T.DoubleType()),
    T.StructField("fast_ma_period", T.IntegerType()),
    T.StructField("slow_ma_period", T.IntegerType()),
    T.StructField("sl_atr_multiple", T.DoubleType()),
    T.StructField("tp_rr_ratio", T.DoubleType()),
    T.StructField("duration_candles", T.IntegerType()),
    T.StructField("duration_minutes", T.DoubleType()),
    T.StructField("equity_after", T.DoubleType()),
    T.StructField("balance_after", T.DoubleType()),
    T.StructField("drawdown_pct", T.DoubleType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Raise while the plan is being built if a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: required columns missing: {missing}")
    return df
