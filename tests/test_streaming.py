"""Streaming forms against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.operators import monitor
from candlewick.streaming import bars as stb
from candlewick.streaming import monitor as stm

SF = "/root/testdata/sf0.001"


def replay(spark, df, folder, parts, by):
    """Write ``df`` as files in time order and read them back as a stream, one file per trigger."""
    cuts = df.approxQuantile(by, [i / parts for i in range(1, parts)], 0.0)
    for i, (lo, hi) in enumerate(zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True)):
        df.filter((F.col(by) > lo) & (F.col(by) <= hi)).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    return stream


def drain(stream, name, tmp, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp}/{name}").trigger(availableNow=True).start()
    try:
        q.awaitTermination(240)
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def test_stream_bars_equal_closed_batch_bars(spark, tmp_path):
    ticks = b.ticks(spark, SF).withColumn("n", F.unix_seconds("ts").cast("double"))
    doubled = ticks.unionByName(ticks.filter("seq % 50 = 0"))
    got = drain(stb.stream_bars(replay(spark, doubled, str(tmp_path / "t"), 4, "n"), "H1"), "bars_out", tmp_path).toPandas()
    want = b.bars(spark, SF).select("symbol", "ts", "open", "high", "low", "close", "volume").toPandas()
    last = ticks.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    closed = want[want.ts + timedelta(hours=1) <= last]
    key = ["symbol", "ts"]
    merged = closed.merge(got, on=key, suffixes=("", "_s"))
    assert len(got) == len(closed) == len(merged)
    for c in ("open", "high", "low", "close", "volume"):
        assert (merged[c] == merged[f"{c}_s"]).all()


@pytest.mark.parametrize("timeframe", ["M15", "H1", "H4"])
def test_bar_chain_equals_batch(spark, tmp_path, timeframe):
    """M15 from ticks, H1 from M15, H4 from H1 in one stream; ticks arrive up to half an hour late and some twice."""
    from candlewick.operators import bars as ob

    ticks = b.ticks(spark, SF).filter("symbol IN ('click', 'view')")
    late = F.pmod(F.xxhash64("seq"), F.lit(1800))
    arriving = ticks.unionByName(ticks.filter("seq % 50 = 0")).withColumn("n", (F.unix_seconds("ts") + late).cast("double"))
    chain = stb.bar_chain(replay(spark, arriving, str(tmp_path / "t"), 4, "n"), late_by="40 minutes")
    got = drain(chain[timeframe], f"chain_{timeframe}", tmp_path).toPandas()
    end = ticks.agg(F.max("ts")).first()[0] - timedelta(minutes=40)
    minutes = {"M15": 15, "H1": 60, "H4": 240}[timeframe]
    want = ob.ticks_to_bars(ticks, timeframe).toPandas()
    want = want[want.ts + timedelta(minutes=minutes) <= end]
    merged = want.merge(got, on=["symbol", "timeframe", "ts"], suffixes=("", "_s"))
    assert len(got) == len(want) == len(merged) > 20
    for c in ("open", "high", "low", "close", "volume"):
        assert (merged[c] - merged[f"{c}_s"]).abs().max() < 1e-9


def test_bar_chain_needs_multiples(spark):
    with pytest.raises(ValueError, match="multiple"):
        stb.bar_chain(spark.readStream.format("rate").load().selectExpr("'a' AS symbol", "timestamp AS ts", "1.0 AS price", "1.0 AS volume", "value AS seq"), ("H1", "M15"))


def test_as_of_stream_equals_batch(spark, tmp_path):
    """Ticks and closed bars from two streams that advance unevenly; rows without a bar in reach stay."""
    from candlewick.operators import trades

    ticks = b.ticks(spark, SF).filter("symbol = 'click' OR seq % 40 = 0").select("symbol", "seq", "ts")
    bars = b.bars(spark, SF).filter("symbol IN ('click', 'view')").select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"), "close")
    n = lambda c: F.unix_seconds(c).cast("double")
    streams = replay(spark, ticks.withColumn("n", n("ts")), str(tmp_path / "l"), 3, "n"), replay(spark, bars.withColumn("n", n("at")), str(tmp_path / "r"), 2, "n")
    got = drain(stb.as_of_stream(*[s.drop("n") for s in streams], ["seq"], ["close"], "3 hours"), "as_of_out", tmp_path).toPandas()
    end = min(ticks.agg(F.max("ts")).first()[0], bars.agg(F.max("at")).first()[0]) - timedelta(minutes=10)
    want = trades.as_of(ticks, bars, ["symbol"], "ts", "at", ["close"], ["seq"]).toPandas()
    old = want.as_of_ts <= want.ts - timedelta(hours=3)
    want.loc[old, ["as_of_ts", "close"]] = None
    sure = want[want.ts < end - timedelta(hours=3)]
    merged = sure.merge(got, on=["symbol", "seq"], suffixes=("", "_s"), how="left", indicator=True)
    assert (merged._merge == "both").all() and len(got) == got.seq.nunique() and len(sure) > 100
    assert (merged.as_of_ts.fillna(end) == merged.as_of_ts_s.fillna(end)).all() and (merged.close.fillna(-1) == merged.close_s.fillna(-1)).all()
    assert merged.close.isna().any() and merged.close.notna().any()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def monitored(spark):
    """Trades of few strategies, so that each has hundreds, with an arrival order that is off by up to two days."""
    t = b.trades(spark, SF).select((F.xxhash64("account") % 3).alias("strategy_id"), F.xxhash64(*b.TRADE_ORDER).alias("trade_id"), "net_pnl", F.col("exit_time").alias("closed_at"))
    t = t.withColumn("n", F.unix_seconds("closed_at") + F.pmod(F.xxhash64("trade_id", F.lit(3)), F.lit(172_800)).cast("double")).cache()
    base = spark.createDataFrame([(-2, 0.6, 1.6, 0.9), (-1, 0.9, 0.1, 0.2), (0, 0.5, 5.0, 0.5), (1, 0.95, 2.0, 0.1), (2, 0.4, 0.0, 0.0)], "strategy_id bigint, p0 double, wf_median_pf double, wf_win_rate double")
    return t, base


def numbered(t):
    from candlewick.functions import ordered
    return ordered.index_rows(t, ["strategy_id"], [F.col("closed_at"), F.col("trade_id")], ordered.time_chunk(F.col("closed_at"), 86400 * 30), out="trade_no")


def test_stream_monitor_equals_batch_after_a_restart(rocks, tmp_path):
    """Shuffled arrival in six files; the query is stopped after three and goes on from its checkpoint."""
    spark = rocks
    t, base = monitored(spark)
    cuts = t.approxQuantile("n", [i / 6 for i in range(1, 6)], 0.0)
    land, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    ranges = list(zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True))
    for part in (ranges[:3], ranges[3:]):
        for lo, hi in part:
            t.filter((F.col("n") > lo) & (F.col("n") <= hi)).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(land)
        q = stm.degradation_stream(stream, base, "2 days").writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        assert q.awaitTermination(240)
    got = spark.read.parquet(out).toPandas()
    end = t.agg(F.max("closed_at")).first()[0] - timedelta(days=2)
    cols = ["strategy_id", "trade_id", "closed_at", "trade_no", "net_pnl", "rolling_trades", "rolling_win_rate", "rolling_pf", "rolling_net_pnl", "loss_streak", "max_loss_streak", "wins",
            "alerts", "alert_count", "cusum_score", "cusum_tripped", "trip_no", "status", "rerun_recommended"]
    states = monitor.degradation(numbered(t), base)
    first = states.groupBy("strategy_id").agg(F.min("trip_no").alias("trip_no"))
    want = states.drop("trip_no").join(first, "strategy_id").withColumn("trip_no", F.when(F.col("cusum_tripped"), F.col("trip_no"))).filter(F.col("closed_at") <= F.lit(end)).select(*cols).toPandas()
    m = want.merge(got, on=["strategy_id", "trade_id"], suffixes=("", "_s"))
    assert len(m) == len(want) == len(got) > 500
    for c in cols[2:]:
        if c in ("rolling_win_rate", "rolling_pf", "rolling_net_pnl", "cusum_score", "net_pnl"):
            assert ((m[c] - m[f"{c}_s"]).abs().fillna(0) < 1e-6 * (1 + m[c].abs().replace(float("inf"), 0))).all(), c
        elif c == "alerts":
            assert all(list(x) == list(y) for x, y in zip(m[c], m[f"{c}_s"], strict=True))
        else:
            assert (m[c].fillna(-1) == m[f"{c}_s"].fillna(-1)).all(), c
    assert m.cusum_tripped.any() and m.alert_count.max() > 3 and set(m.status) >= {"OK", "DEGRADED"}


def test_state_goes_after_a_pause(rocks, tmp_path):
    """A strategy silent for longer than ``forget_days`` starts afresh; another one that trades on keeps its count."""
    spark = rocks
    t0 = datetime(2026, 1, 1)
    rows = [(1, i, -1.0, t0 + timedelta(hours=i)) for i in range(3)] + [(2, 100 + d, 1.0, t0 + timedelta(days=d)) for d in range(60)] + [(1, 50, -1.0, t0 + timedelta(days=59))]
    df = spark.createDataFrame(rows, "strategy_id bigint, trade_id bigint, net_pnl double, closed_at timestamp").withColumn("n", F.unix_seconds("closed_at").cast("double"))
    base = spark.createDataFrame([(1, 0.6, 1.0, 0.6), (2, 0.6, 1.0, 0.6)], "strategy_id bigint, p0 double, wf_median_pf double, wf_win_rate double")
    got = drain(stm.cusum_stream(replay(spark, df, str(tmp_path / "f"), 4, "n"), base, "0 seconds", 20), "forget_out", tmp_path).collect()
    assert {r.trade_id: r.trade_no for r in got if r.strategy_id == 1} == {0: 1, 1: 2, 2: 3, 50: 1}
    assert max(r.trade_no for r in got if r.strategy_id == 2) == 60


def test_signal_sink_matches_live_signals(spark, tmp_path):
    bars = b.bars(spark, SF).filter("symbol IN ('click', 'view')").withColumn("n", F.unix_seconds("ts").cast("double"))
    sink = stb.signal_sink(str(tmp_path / "bars"), str(tmp_path / "out"), "rsi_reversion", {"rsi_oversold": 45, "rsi_overbought": 55})
    stream = replay(spark, bars, str(tmp_path / "s"), 2, "n").drop("n")
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out"))
    want = stb.live_signals(bars.drop("n"), "rsi_reversion", {"rsi_oversold": 45, "rsi_overbought": 55})
    newest = out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0])
    assert sorted((r.symbol, r.ts, r.signal, r.reason) for r in newest.collect()) == sorted((r.symbol, r.ts, r.signal, r.reason) for r in want.collect())


def test_signal_sink_keeps_all_bars_an_average_needs(spark, tmp_path):
    """Daily bars: the newest 300 reach back more than a year, and a replayed batch changes nothing."""
    rows = [("A", "D1", datetime(2022, 1, 1) + timedelta(days=i), *[100.0 + (i * 37 % 11) + i / 50] * 4, 1.0) for i in range(340)]
    bars = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double")
    params = {"fast_ma_period": 2, "slow_ma_period": 200}
    sink = stb.signal_sink(str(tmp_path / "bars"), str(tmp_path / "out"), "ma_crossover", params, "D1")
    day = F.datediff("ts", F.lit("2022-01-01"))
    for batch, (lo, hi) in enumerate(((0, 330), (330, 338), (338, 340), (338, 340))):
        sink(bars.filter((day >= lo) & (day < hi)), min(batch, 2))
    got = spark.read.parquet(str(tmp_path / "out" / "batch=2")).collect()
    want = stb.live_signals(bars, "ma_crossover", params).collect()
    assert [(r.ts, r.signal, r.reason) for r in got] == [(r.ts, r.signal, r.reason) for r in want]
    assert "missing_input" not in got[0].reason and spark.read.parquet(str(tmp_path / "bars_last" / "batch=2")).count() == 300


def test_staleness_fires(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [("A", t0, 0.0), ("B", t0, 0.0), ("B", t0 + timedelta(minutes=30), 1.0), ("B", t0 + timedelta(minutes=70), 2.0), ("B", t0 + timedelta(minutes=71), 3.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, n double")
    got = drain(stm.staleness_stream(replay(spark, df, str(tmp_path / "w"), 4, "n")), "stale_out", tmp_path).filter("stale").collect()
    assert [(r.symbol, r.last_candle) for r in got] == [("A", t0)]


@pytest.mark.parametrize("p0", [0.01, 0.3, 0.55, 0.99])
def test_reference_value_twins(spark, p0):
    assert spark.range(1).select(monitor.cusum_reference(F.lit(p0))).first()[0] == pytest.approx(monitor.cusum_reference_value(p0))
