"""Small hand inputs with known results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.functions import calendar, money, ordered
from candlewick.operators import bars as ob
from candlewick.operators import grid, history, mandate, metrics, monitor, quality, scoring, signals, trades
from candlewick.operators import indicators as ind
from candlewick.schemas import INSTRUMENT
from candlewick.sources import bars as sb
from candlewick.sources import logs

T0 = datetime(2026, 1, 1)
MANDATE = {"max_daily_loss_pct": 5.0, "max_overall_drawdown_pct": 10.0, "drawdown_type": "static", "min_trading_days": 5,
           "max_daily_risk_pct": 1.0, "symbol_universe": ["EURUSD"]}


def at(s):
    return datetime.fromisoformat(s)


def test_donchian_shift(spark):
    rows = [("A", T0 + timedelta(hours=i), i + 1, h, lo, 0.0) for i, (h, lo) in enumerate(zip((10., 12., 15., 14., 13.), (8., 9., 11., 10., 9.), strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, row_no bigint, high double, low double, close double")
    got = ind.donchian(df, 2).orderBy("row_no").collect()
    assert [r.upper for r in got[:3]] == [None, None, 12.0]
    assert (got[2].lower, got[2].mid) == (8.0, 10.0)


@pytest.mark.parametrize("call", [lambda d: ind.sma(d, 0), lambda d: ind.rsi(d, 1), lambda d: ind.bollinger(d, 20, 0.0), lambda d: ind.adx(d, 1)])
def test_bad_periods(spark, call):
    with pytest.raises(ind.IndicatorError):
        call(spark.range(1))


SPEC = [("EURUSD", 5, 0.00001, 100000.0, 0.00001, 1.0, 0.01, 0.01, 100.0, 0, 10, -5.0, 2.0),
        ("XAUUSD", 2, 0.01, 100.0, 0.01, 1.0, 0.01, 0.01, 100.0, 0, 20, -10.0, 15.0)]


def test_golden_pnl(spark):
    t = spark.createDataFrame([
        ("EURUSD", "BUY", 1.0, 1.10000, 1.10100, at("2024-01-01 12:00"), at("2024-01-02 12:00"), "TP_HIT", 1, "LONDON", 1.0),
        ("XAUUSD", "SELL", 0.5, 2300.0, 2290.0, at("2024-01-02 12:00"), at("2024-01-04 12:00"), "TP_HIT", 1, "LONDON", 1.0)],
        "symbol string, direction string, lots double, entry_price double, exit_price double, entry_time timestamp, exit_time timestamp, close_reason string, "
        "exit_no bigint, exit_session string, exit_atr_ratio double")
    got = {r.symbol: r for r in trades.with_pnl(t, spark.createDataFrame(SPEC, INSTRUMENT)).collect()}
    e, x = got["EURUSD"], got["XAUUSD"]
    assert (round(e.gross_pnl, 6), e.commission, e.swap_cost, round(e.net_pnl, 6)) == (100.0, 7.0, -5.0, 88.0)
    # Tuesday and Wednesday rollovers: one night plus three
    assert (round(x.gross_pnl, 6), x.commission, x.swap_cost, round(x.net_pnl, 6)) == (500.0, 3.5, 30.0, 526.5)


def test_sizing(spark):
    c = lambda v: F.lit(float(v))
    lots = lambda cap, dist, vmin: money.lots_for_risk(c(cap), c(1), c(dist), c(0.00001), c(1), c(vmin), c(0.01), c(100))
    r = spark.range(1).select(lots(10000, 0.002, 0.01).alias("a"), lots(10000, 0.0, 0.01).alias("b"), lots(10, 0.01, 1.0).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.5, 0.0, 0.0)


def bars_df(spark, closes, start=T0, minutes=15, volume=100.0):
    return spark.createDataFrame([("EURUSD", "M15", start + timedelta(minutes=minutes * i), c, c, c, c, volume) for i, c in enumerate(closes)],
                                 "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double")


def test_merge_live_wins(spark):
    h = bars_df(spark, [1.1] * 5)
    lv = bars_df(spark, [1.2] * 4, T0 + timedelta(minutes=45), volume=999.0)
    m = {r.ts: r for r in ob.merge_history_and_live(h, lv).collect()}
    assert len(m) == 7
    assert (m[T0 + timedelta(minutes=45)].close, m[T0 + timedelta(minutes=45)].volume) == (1.2, 999.0)
    p = ob.price_contradictions(h, lv).first()
    assert p.overlap == 2 and p.contradiction


def test_merge_rejects_nan_and_missing_columns(spark):
    with pytest.raises(Exception, match="NaN values"):
        ob.merge_history_and_live(bars_df(spark, [1.1, float("nan")]), bars_df(spark, [1.1])).collect()
    with pytest.raises(ValueError, match="volume"):
        ob.merge_history_and_live(bars_df(spark, [1.1]).drop("volume"), bars_df(spark, [1.1]))


def test_minute_export(spark):
    lines = ["<DATE> <TIME> <OPEN> <HIGH> <LOW> <CLOSE> <TICKVOL> <VOL> <SPREAD>",
             "1985.05.20 00:00:00   0.6445  0.6457  0.6442  0.6445  301  0  50", "1985.05.20\t00:00:00 9 9 9 9 1 0 1",
             "1985.99.20 00:01:00 1 1 1 1 1 0 1", "1985.05.20 00:02:00 1 0.5 2 1 1 0 1", "1985.05.20 00:03:00 0 1 0 1 1 0 1"]
    df = spark.createDataFrame([("X", s, i) for i, s in enumerate(lines)], "symbol string, line string, line_no int")
    got = sb.load_minute_export(df).collect()
    assert [(r.ts, r.open, r.spread) for r in got] == [(at("1985-05-20 00:00"), 0.6445, 50.0)]
    rep = sb.parse_report(sb.parse_minute_export(df)).first()
    assert (rep.raw_rows, rep.bad_timestamps, rep.duplicates, rep.invalid_ohlc, rep.clean_rows) == (5, 1, 1, 2, 1)


def test_bars_round_trip_and_warmup(spark, tmp_path):
    sb.write_bars(bars_df(spark, [float(i) for i in range(40)]), str(tmp_path / "bars"))
    back = sb.read_bars(spark, str(tmp_path / "bars"))
    idx = ordered.index_rows(back, ["symbol"], [F.col("ts")], ordered.time_chunk(F.col("ts"), 3600))
    got = sb.slice_with_warmup(idx, T0 + timedelta(minutes=150), T0 + timedelta(minutes=180), 4).orderBy("ts").collect()
    assert [r.close for r in got] == [6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0]
    assert [r.is_warmup for r in got] == [True] * 4 + [False] * 3
    plan = sb.slice_bars(back, "EURUSD", "M15", T0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "GreaterThanOrEqual(ts" in plan


def curve(spark, points):
    return spark.createDataFrame([("a", i, at(t), e) for i, (t, e) in enumerate(points)], "account string, seq bigint, ts timestamp, equity double")


@pytest.mark.parametrize(("points", "daily", "want"), [
    ([("2026-07-30 10:00", 10000.0), ("2026-07-30 14:00", 10100.0), ("2026-07-31 10:00", 10200.0)], 5.0, None),
    ([("2026-07-30 00:00", 10000.0), ("2026-07-30 12:00", 9400.0)], 5.0, "MANDATE_DAILY_LOSS_BREACH"),
    ([("2026-07-30 10:00", 10000.0), ("2026-07-31 10:00", 9600.0), ("2026-08-01 10:00", 8800.0)], 5.0, "MANDATE_OVERALL_DD_BREACH"),
    ([("2026-01-01 22:50", 100000.0), ("2026-01-01 22:55", 97000.0), ("2026-01-01 23:10", 93500.0)], 5.0, None),
    ([("2026-01-01 10:00", 100000.0), ("2026-01-01 15:00", 95800.0)], 4.0, "MANDATE_DAILY_LOSS_BREACH")])
def test_mandate_curves(spark, points, daily, want):
    m = {**MANDATE, "max_daily_loss_pct": daily}
    p = mandate.curve_points(curve(spark, points), ["account"], ["seq"], F.floor(F.col("seq") / 2), points[0][1], m)
    assert mandate.first_breach(p, ["account"], ["seq"], m).first().breach == want


def test_strict_curve_raises(spark):
    c = curve(spark, [("2026-01-01 10:00", 1.0), ("2026-01-01 11:00", float("nan"))])
    with pytest.raises(Exception, match="NON_FINITE_EQUITY"):
        mandate.curve_points(c, ["account"], ["seq"], F.lit(0), 1.0, MANDATE, strict=True).collect()


def test_stress_limits(spark):
    data = [("c", i, T0 + timedelta(days=i, hours=10), T0 + timedelta(days=i, hours=10, minutes=30), 1.0, 50.0 if i % 2 == 0 else -30.0) for i in range(40)]
    t = spark.createDataFrame(data, "candidate_id string, trade_id bigint, entry_time timestamp, exit_time timestamp, lots double, net_pnl double")
    run = lambda m: mandate.stress_test(t, ["candidate_id"], ["trade_id"], m, 10000.0, F.lit(10.0), 20).first()
    assert run({**MANDATE, "max_daily_loss_pct": 20.0, "max_overall_drawdown_pct": 20.0}).breach_rate_pct == 0.0
    assert run({**MANDATE, "max_daily_loss_pct": 0.00001, "max_overall_drawdown_pct": 0.00001}).breach_rate_pct > 50.0


def test_broker_time(spark):
    rows = [("s", i, at(t)) for i, t in enumerate(["2026-01-15 12:00", "2026-03-29 02:59", "2026-03-29 03:30", "2026-03-29 04:00", "2026-07-15 12:00",
                                                  "2026-10-25 02:45", "2026-10-25 03:15", "2026-10-25 03:45", "2026-10-25 03:15", "2026-10-25 03:59", "2026-10-25 04:00"])]
    df = spark.createDataFrame(rows, "s string, seq bigint, local timestamp")
    got = [(r.ts_utc, r.dst_rule) for r in calendar.broker_column_to_utc(df, ["s"], "seq", "local").orderBy("seq").collect()]
    assert [g[0] for g in got] == [at(f"2026-{t}") for t in ("01-15 10:00", "03-29 00:59", "03-29 01:00", "03-29 01:00", "07-15 09:00", "10-24 23:45",
                                                            "10-25 00:15", "10-25 00:45", "10-25 01:15", "10-25 01:59", "10-25 02:00")]
    assert got[2][1] == "MISSING_SHIFTED" and got[8][1] == "REPEATED_SECOND"


def test_hybrid_signals(spark):
    cols = "close double, sma_slow double, adx double, rsi double, rsi_prev double, atr double, session string, atr_ratio double"
    buy, sell = (1.11, 1.10, 25.0, 31.0, 28.0, 0.001, "LONDON", 1.0), (1.09, 1.10, 25.0, 69.0, 72.0, 0.001, "LONDON", 1.0)
    holes = [tuple(None if i == k else v for i, v in enumerate(buy)) for k in range(6)]
    p = {"rsi_oversold": 30, "rsi_overbought": 70, "adx_threshold": 20, "sl_atr_multiple": 2.0, "tp_rr_ratio": 2.0}
    got = signals.with_signals(spark.createDataFrame([buy, sell, *holes], cols).coalesce(1), "hybrid_confluence", p).collect()
    assert [r.signal for r in got] == ["BUY", "SELL"] + ["HOLD"] * 6
    assert got[0].sl_price == pytest.approx(1.108) and got[0].tp_price == pytest.approx(1.114) and got[0].confidence == "HIGH"
    assert got[2].reason == "missing_input name=close" and got[0].reason.startswith("trend_and_rsi_long close=1.11000 sma_slow=1.10000 adx=25.00000")


def test_combo_names():
    assert signals.parse_combo("combo_ma_crossover__rsi_reversion") == ("ma_crossover", "rsi_reversion")
    assert signals.parse_combo("combo_donchian_breakout_rsi_reversion") == ("donchian_breakout", "rsi_reversion")
    assert signals.parse_combo("ma_crossover") is None
    with pytest.raises(ValueError):
        signals.parse_combo("combo_nope__rsi_reversion")


def test_grid_sizes(spark):
    assert {t: grid.grid_size(spark, t).first().grid_size for t in grid.SPACES} == {
        "ma_crossover": 720, "rsi_reversion": 14400, "donchian_breakout": 1020, "hybrid_confluence": 432}


def losses(spark, pnls):
    return spark.createDataFrame([("s", i + 1, p) for i, p in enumerate(pnls)], "strategy_id string, trade_no bigint, net_pnl double")


BASE = [("s", 1.2, 0.55, 0.55)]


def test_cusum_trips_on_losses(spark):
    b = spark.createDataFrame(BASE, "strategy_id string, wf_median_pf double, wf_win_rate double, p0 double")
    k = b.select(monitor.cusum_reference(F.col("p0"))).first()[0]
    assert 0.4675 < k < 0.55 and k == pytest.approx(monitor.cusum_reference_value(0.55))
    last = monitor.latest_summary(monitor.degradation(losses(spark, [-50.0] * 30), b)).first()
    assert last.cusum_tripped and last.trip_no >= 20 and last.status == "DEGRADED"
    good = monitor.latest_summary(monitor.degradation(losses(spark, ([50.0] * 4 + [-50.0]) * 10), b)).first()
    assert not good.cusum_tripped and good.cusum_score < 12 and good.status == "OK"


def test_region_statistics_floor(spark):
    rows = lambda n: spark.createDataFrame([("ma_crossover", "X", 0.5, {"fast_ma_period": "10"})] * n, "template string, symbol string, composite_score double, parameters map<string,string>")
    assert history.region_statistics(rows(15)).count() == 0
    assert history.region_statistics(rows(30)).first()["count"] == 30


def test_logs(spark):
    data = [("/x/engine.log", "2026-07-30 02:00:00,100 | INFO | started"), ("/x/engine.log", "2026-07-30 02:01:00,100 | ERROR | boom"), ("/x/engine.log", "odd line"),
            ("/x/trainer.jsonl", '{"timestamp":"2026-07-30T02:02:00Z","event_type":"TRAIN_FAILURE","message":"m"}'), ("/x/trainer.jsonl", '{"timestamp":"2026-07-30T02:03:00Z","level":"warning"}'),
            ("/x/trainer.jsonl", "{bad")]
    e = logs.parse_entries(spark.createDataFrame(data, "path string, line string"))
    assert e.count() == 5 and logs.query_entries(e, level="error").count() == 2
    assert {r.source_system for r in e.collect()} == {"ENGINE", "TRAINER"}


def test_trade_log_files(spark, tmp_path):
    p = str(tmp_path / "log")
    t = spark.createDataFrame([(f"T{i}", float(i), T0 + timedelta(days=i)) for i in range(4)], "trade_id string, net_pnl double, exit_time timestamp")
    logs.append_trades(t, p)
    logs.append_events(t.select(F.lit("SKIP").alias("event_type"), F.col("exit_time").alias("event_time")), p)
    rec = logs.read_log(spark, p)
    assert logs.trade_records(rec).count() == 4 and logs.event_records(rec).count() == 4
    assert [r.trade_id for r in logs.recent_trades(rec, 2).collect()] == ["T3", "T2"]
    logs.compact_old_days(spark, p, str(tmp_path / "old"), "20260103")
    assert logs.trade_records(logs.read_log(spark, str(tmp_path / "old"))).count() == 2
    assert list((tmp_path / "old").rglob("*.gz"))


def test_empty_and_passing_summaries(spark):
    none = spark.createDataFrame([("c", 1, "INSUFFICIENT_DATA", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, True, None)],
                                 "candidate_id string, window_num int, status string, oos_trades bigint, oos_profit_factor double, oos_calmar double, oos_net_profit double, "
                                 "oos_win_rate double, oos_max_drawdown double, oos_max_consec_losses int, oos_composite_score double, oos_mandate_compliant boolean, oos_mandate_breach_reason string")
    s = scoring.aggregate_windows(none).first()
    assert (s.valid_windows, s.median_max_drawdown_pct, s.max_consecutive_losses, s.temporal_stable) == (0, 100.0, 99, False)
    edge = spark.createDataFrame([("e", 100, 20.0, 12, 20.0, 1.1, 0.55, 10, True, 5)],
                                 "candidate_id string, total_trades int, median_trades_per_window double, valid_windows int, median_max_drawdown_pct double, median_profit_factor double, "
                                 "profitable_window_rate double, max_consecutive_losses int, mandate_compliant boolean, trading_days int")
    assert scoring.hard_gates(edge, MANDATE).first().gates_passed
    over = scoring.hard_gates(edge.withColumn("breach_rate_pct", F.lit(3.1)), MANDATE).first()
    assert not over.gates_passed and over.failed_gate == "gate_10_monte_carlo_stress"
    with pytest.raises(Exception, match="trial_count"):
        scoring.composite_score(spark.createDataFrame([(1.0, 1.0, 1.0, 0.5, True, 0.0, 5.0)], "median_calmar_ratio double, median_profit_factor double, median_avg_win_loss double, "
                                                      "regime_consistency double, temporal_stable boolean, temporal_trend_pct double, worst_oos_drawdown_pct double"), 0).collect()


def test_quality_status(spark):
    b = bars_df(spark, [1.0] * 50)
    expected = spark.createDataFrame([("EURUSD", "M15"), ("EURUSD", "H1")], "symbol string, timeframe string")
    got = {r.timeframe: r for r in quality.check_all(b, expected).collect()}
    assert got["H1"].status == "MISSING" and got["M15"].status == "CRITICAL" and got["M15"].findings == ["SHORT_HISTORY"]


def test_metrics_negative_span_raises(spark):
    t = spark.createDataFrame([("a", 1, T0 + timedelta(days=2), T0, 5.0)], "account string, seq bigint, entry_time timestamp, exit_time timestamp, net_pnl double")
    with pytest.raises(Exception, match="ends before"):
        metrics.summary(t, ["account"], ["seq"], F.lit(0), 100.0).collect()
