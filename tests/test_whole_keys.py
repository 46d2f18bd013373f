"""Keys that fit one chunk are shuffled once and give what chunks give."""

import random

import pytest
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.operators import mandate, monitor

M = {"drawdown_type": "static", "max_daily_loss_pct": 4.0, "max_overall_drawdown_pct": 8.0}


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(3)
    rows = [(None if a == 3 else f"a{a}", i, rng.gauss(1, 900), f"2024-01-{1 + i // 12:02d} {i % 12:02d}:30:00") for a in range(4) for i in range(200)]
    return spark.createDataFrame(rows, "account string, no long, net_pnl double, at string").withColumn("exit_time", F.to_timestamp("at")).drop("at").cache()


def rows(df):
    return sorted([tuple(None if v is None else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect()], key=str)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("descending", [False, True])
def test_running(trades, descending):
    x = F.when(F.col("no") % 3 == 0, F.col("net_pnl"))
    specs = {"s": ("sum", x), "s0": ("sum", x, True), "hi": ("max", x), "lo": ("min", x, True), "la": ("last", x), "w": ("walk", F.col("net_pnl"))}
    run = lambda chunk: ordered.running(trades, ["account"], ["no"], chunk, specs, descending)
    assert run(None).columns == run(F.floor(F.col("no") / 17)).columns
    assert rows(run(None)) == rows(run(F.floor(F.col("no") / 17)))
    number = lambda chunk: rows(ordered.index_rows(trades, ["account"], [F.col("no")], chunk))
    assert number(None) == number(F.floor(F.col("no") / 17))


def test_limits_move_rows_once(trades):
    points = lambda chunk: mandate.trade_points(trades, ["account"], ["exit_time", "no"], chunk, 1e5, M)
    chunk = F.floor(F.col("no") / 17)
    assert rows(points(None)) == rows(points(chunk))
    assert exchanges(mandate.first_breach(points(None), ["account"], ["exit_time", "no"], M)) == 1
    curve = trades.select("account", "no", F.col("exit_time").alias("ts"), (F.col("net_pnl") + 1e5).alias("equity"))
    status = lambda chunk: mandate.breaker_status(curve, ["account"], ["no"], chunk, 1e5, M)
    assert rows(status(None)) == rows(status(chunk))
    assert exchanges(status(None)) == 1


def test_degradation(spark, trades):
    t = trades.filter("account IS NOT NULL").withColumn("trade_no", F.col("no") + 1).select(F.col("account").alias("strategy_id"), "trade_no", "net_pnl")
    base = spark.createDataFrame([(f"a{i}", 1.2, 0.55, 0.6) for i in range(3)], "strategy_id string, wf_median_pf double, wf_win_rate double, p0 double")
    run = lambda **kw: monitor.degradation(t, base, **kw)
    assert rows(run(whole=True).select(sorted(run().columns))) == rows(run().select(sorted(run().columns)))
    assert rows(monitor.latest_summary(run(whole=True)).select("strategy_id", "trade_no", "status", "cusum_score")) == rows(
        run().filter("trade_no = 200").select("strategy_id", "trade_no", "status", "cusum_score"))


def test_a_large_key_stays_in_chunks(trades):
    chunk = F.floor(F.col("no") / 17)
    assert ordered.chunk_unless_small(trades, ["account"], chunk) is None
    assert ordered.chunk_unless_small(trades, ["account"], chunk, rows=199) is chunk
