"""Accounts that grow instead of multiplying: neither the shuffles nor the summaries of chunks grow faster than the trades."""

import pytest
from pyspark.sql import functions as F

from candlewick import bindings
from candlewick.functions import ordered
from candlewick.operators import mandate, metrics

KEYS, ORDER = ["account"], ["exit_time", "no"]
M = {"drawdown_type": "static", "max_daily_loss_pct": 4.0, "max_overall_drawdown_pct": 8.0}


@pytest.fixture(scope="module")
def trades(spark):
    """Two accounts of 6,000 trades, one trade every other hour."""
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("no") * 7200)
    return spark.range(12_000).select((F.col("id") % 2).alias("account"), F.floor(F.col("id") / 2).alias("no")).select(
        "account", "no", at.alias("exit_time"), at.alias("entry_time"), ((F.hash("no", "account") % 1000) / 2.0).alias("net_pnl")).cache()


def rows(df):
    return sorted([tuple(None if v is None else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect()], key=str)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_grown_accounts_are_shuffled_once(trades):
    chunk = bindings.trade_chunk(trades)
    points = mandate.trade_points(trades, KEYS, ORDER, chunk, 1e5, M)
    assert exchanges(mandate.first_breach(points, KEYS, ORDER, M)) == 1


def test_slots_follow_the_densest_one(trades):
    chunk = ordered.time_chunk_unless_small(trades, KEYS, F.col("exit_time"), 3600, rows=500)
    sizes = [r["count"] for r in trades.groupBy("account", chunk.alias("slot")).count().collect()]
    assert max(sizes) <= 500 and len(sizes) <= 2 * 50  # hours made 12,000
    points = lambda c: rows(mandate.trade_points(trades, KEYS, ORDER, c, 1e5, M))
    assert points(chunk) == points(None)
    summary = lambda c: rows(metrics.summary(trades, KEYS, ORDER, c, 1e5))
    assert summary(chunk) == summary(None)


def test_a_dense_hour_keeps_the_slots_short(spark):
    """Slots are the longest that hold no more rows than allowed; a burst above that leaves an hour."""
    busy = spark.range(900).select(F.lit(1).alias("account"), F.timestamp_seconds(F.when(F.col("id") < 300, F.col("id")).otherwise(F.col("id") * 3600)).alias("at"))
    length = lambda rows: busy.select(ordered.time_chunk_unless_small(busy, KEYS, F.col("at"), 3600, rows=rows).alias("s")).distinct().count()
    hours = busy.select(ordered.time_chunk(F.col("at"), 3600).alias("s")).distinct().count()
    assert length(200) == hours
    assert length(899) == 2 and length(512) == 2  # 512 hours: 300 + 212 and 388 rows
    assert length(511) == 4  # 256 hours: 300, 212, 256 and 132
