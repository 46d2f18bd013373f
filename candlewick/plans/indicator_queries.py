"""Queries over indicators."""

import uuid

from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.functions import ordered
from candlewick.functions.staging import fresh_folder, stage
from candlewick.operators import bars as ob
from candlewick.operators import indicators as ind
from candlewick.plans import indicator_sql as isql
from candlewick.plans.bar_queries import rounded, week_windows
from candlewick.plans.registry import ORACLES, query
from candlewick.sources import bar_store


def _mean(col, n):
    return (f"CASE WHEN row_no >= {n} THEN avg({col}) OVER (PARTITION BY symbol ORDER BY row_no "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END")


@query("indicator_sma", b.with_sql("indexed") + f" SELECT symbol, ts, round({_mean('close', 20)}, 6) AS sma FROM indexed")
def indicator_sma(spark, d):
    return rounded(ind.sma(b.indexed_bars(spark, d), 20).select("symbol", "ts", "sma"), ["sma"])


@query("indicator_volume_sma", b.with_sql("indexed") + f""" SELECT symbol, ts, round(volume_sma, 6) AS volume_sma,
 round(volume / volume_sma, 6) AS volume_rel FROM (SELECT *, {_mean('volume', 20)} AS volume_sma FROM indexed)""")
def indicator_volume_sma(spark, d):
    v = ind.volume_sma(b.indexed_bars(spark, d), 20).withColumn("volume_rel", F.try_divide("volume", "volume_sma"))
    return rounded(v.select("symbol", "ts", "volume_sma", "volume_rel"), ["volume_sma", "volume_rel"])


@query("indicator_ema", isql.base() + isql.recursion("e", "ix", "close", 10, 2 / 11) +
       " SELECT symbol, ts, round(y, 6) AS ema FROM ix LEFT JOIN e USING (symbol, row_no)")
def indicator_ema(spark, d):
    return rounded(ind.ema(b.indexed_bars(spark, d), 10).select("symbol", "ts", "ema"), ["ema"])


@query("indicator_rsi", isql.base() + isql.rsi() + " SELECT symbol, ts, round(rsi, 6) AS rsi FROM ix LEFT JOIN rsi USING (symbol, row_no)")
def indicator_rsi(spark, d):
    return rounded(ind.rsi(b.indexed_bars(spark, d)).select("symbol", "ts", "rsi"), ["rsi"])


@query("indicator_macd", isql.base() + isql.recursion("f", "ix", "close", 12, 2 / 13) + isql.recursion("s", "ix", "close", 26, 2 / 27) +
       ", m AS MATERIALIZED (SELECT symbol, row_no, f.y - s.y AS macd FROM f JOIN s USING (symbol, row_no))" +
       isql.recursion("sg", "m", "macd", 9, 0.2, 26) + """ SELECT symbol, ts, round(macd, 6) AS macd, round(sg.y, 6) AS macd_signal,
 round(macd - sg.y, 6) AS macd_hist FROM ix LEFT JOIN m USING (symbol, row_no) LEFT JOIN sg USING (symbol, row_no)""")
def indicator_macd(spark, d):
    cols = ["macd", "macd_signal", "macd_hist"]
    return rounded(ind.macd(b.indexed_bars(spark, d)).select("symbol", "ts", *cols), cols)


@query("indicator_atr", isql.base() + isql.atr() + " SELECT symbol, ts, round(atr, 6) AS atr FROM ix LEFT JOIN atr USING (symbol, row_no)")
def indicator_atr(spark, d):
    return rounded(ind.atr(b.indexed_bars(spark, d)).select("symbol", "ts", "atr"), ["atr"])


@query("indicator_bollinger", b.with_sql("indexed") + f""", m AS (SELECT *, {_mean('close', 20)} AS mid,
 CASE WHEN row_no >= 20 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY row_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sd FROM indexed)
 SELECT symbol, ts, round(mid + 2 * sd, 6) AS bb_upper, round(mid, 6) AS bb_mid, round(mid - 2 * sd, 6) AS bb_lower,
 round(400 * sd / mid, 6) AS bb_width, round((close - (mid - 2 * sd)) / (4 * sd), 6) AS bb_pct FROM m""")
def indicator_bollinger(spark, d):
    cols = ["bb_upper", "bb_mid", "bb_lower", "bb_width", "bb_pct"]
    return rounded(ind.bollinger(b.indexed_bars(spark, d)).select("symbol", "ts", *cols), cols)


@query("indicator_donchian", b.with_sql("indexed") + """, c AS (SELECT *, CASE WHEN row_no > 20 THEN max(high) OVER w END AS upper,
 CASE WHEN row_no > 20 THEN min(low) OVER w END AS lower FROM indexed WINDOW w AS (PARTITION BY symbol ORDER BY row_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
 SELECT symbol, ts, upper, lower, round((upper + lower) / 2, 6) AS mid FROM c""")
def indicator_donchian(spark, d):
    return rounded(ind.donchian(b.indexed_bars(spark, d)).select("symbol", "ts", "upper", "lower", "mid"), ["mid"])


@query("indicator_adx", isql.base() + isql.atr() + isql.adx() + """ SELECT symbol, ts, round(adx, 6) AS adx, round(dmp, 6) AS dmp,
 round(dmn, 6) AS dmn FROM ix LEFT JOIN adx USING (symbol, row_no)""")
def indicator_adx(spark, d):
    cols = ["adx", "dmp", "dmn"]
    return rounded(ind.adx(b.indexed_bars(spark, d)).select("symbol", "ts", *cols), cols)


FEATURE_COLS = ["sma_fast", "sma_slow", "sma_fast_prev", "sma_slow_prev", "rsi", "rsi_prev", "bb_pct", "atr", "adx", "volume_sma",
                "volume_rel", "atr_sma20", "atr_ratio", "donchian_upper_entry", "donchian_lower_entry",
                "donchian_upper_exit", "donchian_lower_exit"]
PARAMS = {"fast_ma_period": 10, "slow_ma_period": 50, "channel_period": 20, "exit_period": 10}


def feature_table(spark, d):
    return ind.features(b.indexed_bars(spark, d), PARAMS)


@query("indicator_features", isql.features() + " SELECT symbol, ts, session, regime, " +
       ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLS) + " FROM feats")
def indicator_features(spark, d):
    return rounded(feature_table(spark, d).select("symbol", "ts", "session", "regime", *FEATURE_COLS), FEATURE_COLS)


@query("indicator_features_stored", ORACLES["indicator_features"])
def indicator_features_stored(spark, d):
    """The same from a store of bars in chunks, half of them appended later; the indicators need no exchange."""
    name, folder, bars = f"bars_{uuid.uuid4().hex}", fresh_folder(spark), stage(b.bars(spark, d))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    bar_store.save(bars.filter(early), name, folder)
    bar_store.append(bars.filter(~early), name)
    rows = bar_store.chunks(spark, name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, the catalogue keeps nothing of this query
    feats = ind.features(rows, PARAMS)
    return rounded(feats.select("symbol", "ts", "session", "regime", *FEATURE_COLS), FEATURE_COLS)


@query("indicator_warmup_defaults", isql.features() + """ SELECT symbol, ts, round(coalesce(rsi, 50), 6) AS rsi, round(coalesce(rsi_prev, 50), 6) AS rsi_prev,
 round(coalesce(bb_pct, 0.5), 6) AS bb_pct, round(coalesce(atr, 0), 6) AS atr, round(coalesce(adx, 0), 6) AS adx,
 round(coalesce(atr_ratio, 1), 6) AS atr_ratio, round(coalesce(volume_rel, 1), 6) AS volume_rel FROM feats""")
def indicator_warmup_defaults(spark, d):
    cols = list(ind.WARMUP_DEFAULTS)
    return rounded(ind.with_warmup_defaults(feature_table(spark, d)).select("symbol", "ts", *cols), cols)


@query("indicator_regime", isql.features() + """ SELECT symbol, regime, count(*) AS bars, round(avg(atr_ratio), 6) AS mean_ratio FROM feats
 GROUP BY symbol, regime""")
def indicator_regime(spark, d):
    return feature_table(spark, d).groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.round(F.avg("atr_ratio"), 6).alias("mean_ratio"))


@query("indicator_crossings", isql.features() + """ SELECT symbol, ts, CASE WHEN sma_fast_prev <= sma_slow_prev AND sma_fast > sma_slow THEN 'ABOVE'
 ELSE 'BELOW' END AS crossed FROM feats WHERE (sma_fast_prev <= sma_slow_prev AND sma_fast > sma_slow) OR (sma_fast_prev >= sma_slow_prev AND sma_fast < sma_slow)""")
def indicator_crossings(spark, d):
    f = feature_table(spark, d)
    four = [F.col(c) for c in ("sma_fast", "sma_fast_prev", "sma_slow", "sma_slow_prev")]
    side = F.when(ind.crossed_above(*four), "ABOVE").when(ind.crossed_below(*four), "BELOW")
    return f.select("symbol", "ts", side.alias("crossed")).filter("crossed IS NOT NULL")


@query("indicator_ma_distance", isql.features() + ", " + b.SQL["specs"] + """ SELECT symbol, ts,
 round(CASE WHEN sma_fast IS NOT NULL AND tick_size > 0 THEN abs(close - sma_fast) / tick_size ELSE 0 END, 2) AS ticks
 FROM feats JOIN specs USING (symbol)""")
def indicator_ma_distance(spark, d):
    f = feature_table(spark, d).join(b.specs(spark), "symbol")
    return f.select("symbol", "ts", ind.ma_distance_ticks(F.col("close"), F.col("sma_fast"), F.col("tick_size")).alias("ticks"))


SMA_PERIODS, EMA_PERIODS, CHANNELS = (5, 10, 15, 20, 30, 50, 80, 100), (5, 20, 100), (20, 40)


@query("indicator_long_form", isql.base() + "".join(isql.recursion(f"e{n}", "ix", "close", n, 2 / (n + 1)) for n in EMA_PERIODS) + """, v AS (
 SELECT symbol, row_no, ts, 'SMA' AS kind, p AS period, CASE WHEN row_no >= p THEN (SELECT avg(j.close) FROM ix j WHERE j.symbol = i.symbol AND j.row_no BETWEEN i.row_no - p + 1 AND i.row_no) END AS value
 FROM ix i, (SELECT unnest([5, 10, 15, 20, 30, 50, 80, 100]) AS p)
 """ + "".join(f" UNION ALL SELECT symbol, row_no, ts, 'EMA', {n}, y FROM ix LEFT JOIN e{n} USING (symbol, row_no)" for n in EMA_PERIODS) +
       "".join(f""" UNION ALL SELECT symbol, row_no, ts, 'CHANNEL', {n}, CASE WHEN row_no > {n} THEN (max(high) OVER w + min(low) OVER w) / 2 END FROM ix
 WINDOW w AS (PARTITION BY symbol ORDER BY row_no ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)""" for n in CHANNELS) + """)
 SELECT symbol, ts, kind, period, round(value, 6) AS value, round(lag(value) OVER (PARTITION BY symbol, kind, period ORDER BY row_no), 6) AS value_prev FROM v""")
def indicator_long_form(spark, d):
    out = ind.long_indicators(b.indexed_bars(spark, d), SMA_PERIODS, EMA_PERIODS, CHANNELS)
    return rounded(out.select("symbol", "ts", "kind", "period", "value", "value_prev"), ["value", "value_prev"])


@query("indicator_lookahead_audit", b.with_sql("bars") + " SELECT symbol, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS compared, 0::BIGINT AS changed, TRUE AS planted_found FROM bars GROUP BY symbol")
def indicator_lookahead_audit(spark, d):
    """Change every bar from mid-month on; earlier features must not move. A planted column that reads the next bar must."""
    bars = b.bars(spark, d)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    wild = bars.withColumns({c: F.when(F.col("ts") >= cut, F.col(c) * 3 + 7).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    cols = ["symbol", "ts", "regime", *FEATURE_COLS]
    compute = lambda x: rounded(ind.features(b.indexed(x), PARAMS).select(*cols), FEATURE_COLS, 9).filter(F.col("ts") < cut)

    def peeking(x):
        i = b.indexed(x)
        after = i.select("symbol", (F.col("row_no") - 1).alias("row_no"), F.col("close").alias("next_close"))
        return i.join(after, ["symbol", "row_no"], "left").filter(F.col("ts") < cut).select("symbol", "ts", "next_close")

    planted = ind.change_audit(peeking(bars), peeking(wild)).select("symbol", (F.col("changed") > 0).alias("planted_found"))
    return ind.change_audit(compute(bars), compute(wild)).join(planted, "symbol").select("symbol", "compared", "changed", "planted_found")


@query("indicator_dominant_regime", isql.features() + """, c AS (SELECT symbol, epoch(date_trunc('week', ts))::BIGINT AS window_id, regime, count(*) AS n
 FROM feats WHERE regime IS NOT NULL GROUP BY ALL) SELECT symbol, window_id, arg_min(regime, -n * 1000 + CASE regime WHEN 'QUIET' THEN 0 WHEN 'RANGING' THEN 1
 WHEN 'TRANSITIONING' THEN 2 WHEN 'TRENDING' THEN 3 ELSE 4 END) AS dominant_regime FROM c GROUP BY symbol, window_id""")
def indicator_dominant_regime(spark, d):
    f = feature_table(spark, d)
    sliced = ob.slice_windows(f, week_windows(b.bars(spark, d)), warmup=0)
    return ind.dominant_regime(sliced, ["symbol", "window_id"])


@query("bars_scan_small_chunks", isql.base() + isql.recursion("e", "ix", "close", 10, 2 / 11) +
       " SELECT symbol, ts, round(y, 6) AS ema FROM ix LEFT JOIN e USING (symbol, row_no)")
def bars_scan_small_chunks(spark, d):
    """The EMA recurrence again, forced into chunks of 64 bars plus halo."""
    halo = ordered.recurrence_halo(ind.ema_alpha(10)) + 10
    rows = ordered.spread(b.indexed_bars(spark, d), halo, 64)
    rows = rows.withColumn("ema", ind.seeded_average("close", 10, ind.ema_alpha(10), 1, halo, 64))
    return rounded(ordered.own_rows(rows).select("symbol", "ts", "ema"), ["ema"])
