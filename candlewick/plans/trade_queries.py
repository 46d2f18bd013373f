"""Queries over signals, sizing, costs, fills, outcomes, single-position runs."""

from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.functions import money
from candlewick.functions.staging import stage
from candlewick.operators import indicators as ind
from candlewick.operators import paths, signals, trades
from candlewick.plans import trade_sql as tsql
from candlewick.plans.bar_queries import rounded
from candlewick.plans.indicator_queries import PARAMS, feature_table
from candlewick.plans.registry import query

CAPITAL = 10_000.0


def ready(spark, d):
    """Features with warm-up defaults, as strategies see them."""
    return ind.with_warmup_defaults(feature_table(spark, d))


# ---- signals

def _signal_sql(name, adx=0, extra="false", lo=30, hi=70, sl=1.5, rr=2.0):
    case = tsql.signal_case(name, adx, lo, hi, extra)
    return tsql.feats() + f""", s AS (SELECT ff.*, {case} AS signal, {tsql.PIP} AS pip FROM ff JOIN specs USING (symbol))
 SELECT symbol, ts, signal, round(CASE signal WHEN 'BUY' THEN close - atr * {sl} WHEN 'SELL' THEN close + atr * {sl} END, 6) AS sl_price,
 round(CASE signal WHEN 'BUY' THEN close + atr * {sl} * {rr} WHEN 'SELL' THEN close - atr * {sl} * {rr} END, 6) AS tp_price,
 round(CASE WHEN signal <> 'HOLD' THEN atr * {sl} / pip END, 4) AS sl_pips, CASE WHEN signal <> 'HOLD' THEN {rr}::DOUBLE END AS rr_ratio,
 CASE WHEN signal <> 'HOLD' THEN '{'HIGH' if adx == 0 or name == 'hybrid_confluence' else 'MEDIUM'}' END AS confidence FROM s"""


def signal_rows(spark, d, name, params):
    pip = money.pip_size(F.col("digits"), F.col("point"))
    f = ready(spark, d).join(b.specs(spark).select("symbol", "digits", "point"), "symbol")
    s = signals.with_signals(f, name, params, pip)
    return rounded(rounded(s, ["sl_price", "tp_price"]), ["sl_pips"], 4).select(
        "symbol", "ts", "signal", "sl_price", "tp_price", "sl_pips", "rr_ratio", "confidence")


@query("signal_ma_crossover", _signal_sql("ma_crossover", adx=20))
def signal_ma_crossover(spark, d):
    return signal_rows(spark, d, "ma_crossover", {"adx_threshold": 20})


@query("signal_rsi_reversion", _signal_sql("rsi_reversion", lo=40, hi=60))
def signal_rsi_reversion(spark, d):
    return signal_rows(spark, d, "rsi_reversion", {"rsi_oversold": 40, "rsi_overbought": 60})


@query("signal_donchian_breakout", _signal_sql("donchian_breakout", adx=15))
def signal_donchian_breakout(spark, d):
    return signal_rows(spark, d, "donchian_breakout", {"adx_min_threshold": 15})


@query("signal_hybrid_confluence", _signal_sql("hybrid_confluence", adx=10, lo=45, hi=55, sl=2.0))
def signal_hybrid_confluence(spark, d):
    return signal_rows(spark, d, "hybrid_confluence", {"adx_threshold": 10, "rsi_oversold": 45, "rsi_overbought": 55})


_BLOCK = "NOT (session IN ('LONDON', 'LONDON_NY_OVERLAP', 'NEW_YORK')) OR atr_ratio < 0.8 OR atr_ratio > 1.3"


@query("signal_session_filters", _signal_sql("donchian_breakout", extra=_BLOCK))
def signal_session_filters(spark, d):
    return signal_rows(spark, d, "donchian_breakout", {
        "allowed_sessions": ["LONDON", "LONDON_NY_OVERLAP", "NEW_YORK"], "atr_ratio_min": 0.8, "atr_ratio_max": 1.3})


@query("signal_block_reasons", tsql.feats() + """, r AS (SELECT symbol, CASE WHEN session = 'DEAD_ZONE' THEN 'closed_hours'
 WHEN session NOT IN ('LONDON', 'NEW_YORK') THEN 'unlisted_session session=' || session WHEN atr_ratio < 0.8 THEN 'quiet_market'
 WHEN atr_ratio > 1.3 THEN 'wild_market' END AS why FROM ff) SELECT symbol, coalesce(why, 'allowed') AS why, count(*) AS n FROM r GROUP BY ALL""")
def signal_block_reasons(spark, d):
    why = signals.block_reason({"allowed_sessions": ["LONDON", "NEW_YORK"], "atr_ratio_min": 0.8, "atr_ratio_max": 1.3})
    code = F.when(F.col("why").endswith("limit=0.8") | F.col("why").endswith("limit=1.3"), F.substring_index("why", " ", 1)).otherwise(F.coalesce("why", F.lit("allowed")))
    return ready(spark, d).withColumn("why", why).groupBy("symbol", code.alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query("signal_reasons", tsql.feats() + f""", s AS (SELECT *, {tsql.signal_case('ma_crossover')} AS signal FROM ff)
 SELECT symbol, ts, CASE signal WHEN 'BUY' THEN printf('ma_cross_long sma_fast=%.5f sma_slow=%.5f', sma_fast, sma_slow)
 ELSE printf('ma_cross_short sma_fast=%.5f sma_slow=%.5f', sma_fast, sma_slow) END AS reason FROM s WHERE signal <> 'HOLD'""")
def signal_reasons(spark, d):
    s = signals.with_signals(ready(spark, d), "ma_crossover", {})
    return s.filter("signal <> 'HOLD'").select("symbol", "ts", "reason")


@query("signal_exit_flags", tsql.feats() + " SELECT symbol, ts, " + ", ".join(
    f"session <> 'DEAD_ZONE' AND coalesce({x[i]}, false) AS {n}_{s}_exit" for n, x in tsql.EXITS.items() for i, s in enumerate(("buy", "sell"))) + " FROM ff")
def signal_exit_flags(spark, d):
    f = ready(spark, d)
    for name in tsql.EXITS:
        f = signals.with_exit_flags(f, name, {"exit_on_opposite_crossover": True})
        f = f.withColumnRenamed("buy_exit", f"{name}_buy_exit").withColumnRenamed("sell_exit", f"{name}_sell_exit")
    return f.select("symbol", "ts", *[f"{n}_{s}_exit" for n in tsql.EXITS for s in ("buy", "sell")])


@query("signal_combo", tsql.feats() + f""", s AS (SELECT *, {tsql.signal_case('donchian_breakout')} AS signal FROM ff) SELECT symbol, ts, signal,
 session <> 'DEAD_ZONE' AND coalesce(rsi >= 50, false) AS buy_exit, session <> 'DEAD_ZONE' AND coalesce(rsi <= 50, false) AS sell_exit FROM s""")
def signal_combo(spark, d):
    name = "combo_donchian_breakout__rsi_reversion"
    s = signals.with_exit_flags(signals.with_signals(ready(spark, d), name, {}), name, {})
    return s.select("symbol", "ts", "signal", "buy_exit", "sell_exit")


@query("signal_latest_live", tsql.feats() + """, s AS (SELECT *, CASE WHEN session = 'DEAD_ZONE' THEN 'HOLD' WHEN sma_fast IS NULL OR sma_slow IS NULL OR atr IS NULL THEN 'HOLD'
 WHEN adx < 20 THEN 'HOLD' WHEN sma_fast_prev <= sma_slow_prev AND sma_fast > sma_slow THEN 'BUY' WHEN sma_fast_prev >= sma_slow_prev AND sma_fast < sma_slow THEN 'SELL' ELSE 'HOLD' END AS signal FROM feats)
 SELECT symbol, ts, session, regime, signal FROM s WHERE row_no = (SELECT max(row_no) FROM feats f WHERE f.symbol = s.symbol)""")
def signal_latest_live(spark, d):
    s = signals.with_signals(feature_table(spark, d), "ma_crossover", {"adx_threshold": 20}, live=True)
    return signals.latest(s).select("symbol", "ts", "session", "regime", "signal")


@query("signal_live_exits", tsql.feats() + """ SELECT t.account, t.direction, f.symbol, f.ts, CASE t.direction WHEN 'BUY' THEN f.rsi_prev >= 50 AND f.rsi < 50
 ELSE f.rsi_prev <= 50 AND f.rsi > 50 END AS should_exit FROM (SELECT c_custkey AS account, CASE WHEN c_acctbal > 4000 THEN 'BUY' ELSE 'SELL' END AS direction,
 ['click', 'error', 'purchase', 'signup', 'view'][c_nationkey % 5 + 1] AS symbol FROM customer) t JOIN ff f USING (symbol) WHERE f.row_no = (SELECT max(row_no) FROM ff g WHERE g.symbol = f.symbol)""")
def signal_live_exits(spark, d):
    names = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    pos = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("account"), F.when(F.col("c_acctbal") > 4000, "BUY").otherwise("SELL").alias("direction"),
        F.element_at(names, F.col("c_nationkey") % 5 + 1).alias("symbol"))
    out = signals.live_exits(pos, signals.latest(ready(spark, d)), "hybrid_confluence", {})
    return out.select("account", "direction", "symbol", "ts", "should_exit")


_CHECK_SRC = """, k AS (SELECT e.event_id, e.event_id % 50 <> 0 AS connected, CASE WHEN e.event_id % 41 = 0 THEN NULL ELSE 'S' || e.user_id END AS strategy_id,
 e.event_id % 13 <> 0 AS data_fresh, e.value AS spread_pips, {sess} AS session, e.user_id % 17 = 0 AS safe_mode, e.user_id % 7 <> 0 AS daily_loss_ok,
 e.user_id % 11 <> 0 AS drawdown_ok, e.value * 100 AS free_margin, e.user_id % 5 AS open_positions, e.event_id % 19 = 0 AS conflicting, e.event_type AS regime FROM events e)"""


@query("signal_checklist", "WITH x AS (SELECT 1)" + _CHECK_SRC.format(sess=b.session_sql("e.ts")) + """, p AS (SELECT event_id, [connected, strategy_id IS NOT NULL, data_fresh, spread_pips <= 60,
 session <> 'DEAD_ZONE' AND list_contains(['LONDON', 'NEW_YORK', 'ASIAN'], session), upper(regime) = 'CLICK' OR event_id % 3 = 0, NOT safe_mode AND daily_loss_ok AND drawdown_ok,
 free_margin >= 100, open_positions < 3 AND NOT conflicting] AS ok FROM k)
 SELECT event_id, list_bool_and(ok) AS all_passed, len(list_filter(ok, lambda x: NOT x)) AS failed_items, list_position(ok, false) AS first_failed FROM p""")
def signal_checklist(spark, d):
    e, i, u = b.table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    src = e.select(
        "event_id", (i % 50 != 0).alias("connected"), F.when(i % 41 != 0, F.concat(F.lit("S"), u)).alias("strategy_id"),
        (i % 13 != 0).alias("data_fresh"), F.lit(12.0).alias("stale_seconds"), F.col("value").alias("spread_pips"), F.lit(60.0).alias("max_spread_pips"),
        signals_session(), F.array(*[F.lit(s) for s in ("LONDON", "NEW_YORK", "ASIAN")]).alias("allowed_sessions"),
        F.col("event_type").alias("regime"), F.when(i % 3 != 0, "CLICK").alias("regime_target"), (u % 17 == 0).alias("safe_mode"),
        (u % 7 != 0).alias("daily_loss_ok"), (u % 11 != 0).alias("drawdown_ok"), (F.col("value") * 100).alias("free_margin"),
        F.lit(100.0).alias("required_margin"), (u % 5).alias("open_positions"), F.lit(3).alias("max_open_positions"), (i % 19 == 0).alias("conflicting"))
    out = signals.checklist(src)
    bad = F.filter("checklist", lambda x: ~x["pass"])
    return out.select("event_id", "all_passed", F.col("failed_items").cast("bigint").alias("failed_items"),
                      F.get(bad, F.lit(0))["item_id"].alias("first_failed"))


def signals_session():
    from candlewick.functions.calendar import session_label
    return session_label(F.col("ts").cast("timestamp")).alias("session")


@query("signal_mandate_gate", """WITH r AS (SELECT event_id, list_filter([CASE WHEN user_id % 17 = 0 THEN 'safe_mode' END, CASE WHEN event_type = 'error' THEN 'symbol_not_traded' END,
 CASE WHEN value > 100 THEN 'risk_too_high' END, CASE WHEN user_id % 7 = 0 THEN 'breaker_open' END, CASE WHEN user_id % 5 = 0 THEN 'day_halted' END], lambda x: x IS NOT NULL) AS v FROM events)
 SELECT event_id, array_to_string(v, ',') AS violations, CASE v[1] WHEN 'symbol_not_traded' THEN v[1] || ' symbol=ERROR' ELSE coalesce(v[1], 'pass') END AS gate_reason, len(v) = 0 AS allowed FROM r""")
def signal_mandate_gate(spark, d):
    u = F.col("user_id")
    src = b.table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), (u % 17 == 0).alias("safe_mode"),
                                             (F.col("value") / 100).alias("risk_per_trade_pct"), (u % 7 == 0).alias("breaker_tripped"), (u % 5 == 0).alias("daily_halt"))
    # the values of a risk too high are left to the tests: engines print decimals differently
    shown = F.when(F.col("gate_reason").startswith("risk_too_high"), "risk_too_high").otherwise(F.col("gate_reason"))
    return signals.mandate_gate(src, b.MANDATE).select("event_id", F.array_join("violations", ",").alias("violations"), shown.alias("gate_reason"), "allowed")


# ---- sizing and costs: every bar as a hypothetical trade

_BT = b.with_sql("bars", "specs") + f""", t AS (SELECT bars.*, specs.* EXCLUDE (symbol), {tsql.PIP} AS pip, CASE WHEN close >= open THEN 'BUY' ELSE 'SELL' END AS direction,
 ts + to_hours((volume * 9)::INT) AS exit_time, {b.session_sql('ts')} AS session FROM bars JOIN specs USING (symbol))"""


def bar_trades(spark, d):
    from candlewick.functions.calendar import session_label
    t = b.bars(spark, d).join(b.specs(spark), "symbol")
    return (t.withColumn("pip", money.pip_size(F.col("digits"), F.col("point")))
            .withColumn("direction", F.when(F.col("close") >= F.col("open"), "BUY").otherwise("SELL"))
            .withColumn("exit_time", F.timestamp_seconds(F.unix_seconds("ts") + (F.col("volume") * 9 * 3600).cast("bigint")))
            .withColumn("session", session_label(F.col("ts"))))


@query("trade_instrument_math", _BT + """ SELECT symbol, ts, round(pip, 6) AS pip, round(tick_value * pip / tick_size, 6) AS pip_value, round((high - low) / pip, 4) AS range_pips,
 round((high - low) / pip * pip, 6) AS range_price, round(abs(open - close) / point, 4) >= stops_level AS far_enough,
 tick_value >= 0.01 AND tick_value <= 10 AS sane FROM t""")
def trade_instrument_math(spark, d):
    c = F.col
    rng = money.price_to_pips(c("high") - c("low"), c("pip"))
    return bar_trades(spark, d).select(
        "symbol", "ts", F.round("pip", 6).alias("pip"), F.round(money.pip_value(c("tick_value"), c("tick_size"), c("pip")), 6).alias("pip_value"),
        F.round(rng, 4).alias("range_pips"), F.round(money.pips_to_price(rng, c("pip")), 6).alias("range_price"),
        money.stop_far_enough(F.round(c("open"), 6), F.round(c("close"), 6), c("point"), c("stops_level")).alias("far_enough"),
        money.tick_value_sane(c("symbol"), c("tick_value")).alias("sane"))


@query("trade_lot_sizing", _BT + f" SELECT symbol, ts, round({tsql.lots('10000.0', '1.0', 'high - low')}, 4) AS lots FROM t")
def trade_lot_sizing(spark, d):
    c = F.col
    return bar_trades(spark, d).select("symbol", "ts", F.round(money.lots_for_risk(
        F.lit(10000.0), F.lit(1.0), c("high") - c("low"), c("tick_size"), c("tick_value"), c("volume_min"), c("volume_step"), c("volume_max")), 4).alias("lots"))


@query("trade_swap", _BT + f""" SELECT symbol, ts, exit_time, {tsql.nights('ts', 'exit_time')} AS nights,
 round(CASE direction WHEN 'BUY' THEN swap_long ELSE swap_short END * 2.0 * {tsql.nights('ts', 'exit_time')}, 4) AS swap FROM t""")
def trade_swap(spark, d):
    from candlewick.functions.calendar import rollover_nights
    n = rollover_nights(F.col("ts"), F.col("exit_time"))
    return bar_trades(spark, d).select("symbol", "ts", "exit_time", n.alias("nights"), F.round(
        money.swap_cost(F.col("direction"), F.col("swap_long"), F.col("swap_short"), F.lit(2.0), n), 4).alias("swap"))


@query("trade_cost_model", _BT + f""" SELECT symbol, ts, round(spread_typical * point / pip * {tsql.sess('session')} * {tsql.vol('volume / 2.5')} * {tsql.noise('spread', 'symbol', 'epoch(ts)::BIGINT')}, 6) AS spread_pips,
 round(0.3 * {tsql.vol('volume / 2.5')} * {tsql.noise('slip', 'symbol', 'epoch(ts)::BIGINT')}, 6) AS slippage_pips, round(1.5 * 7.0 / 2, 4) AS leg_commission,
 round(CASE WHEN (high - low) / pip > 0 THEN (high - low) / pip ELSE 1.0 END, 4) AS quoted_pips FROM t""")
def trade_cost_model(spark, d):
    c = F.col
    ratio, at = c("volume") / 2.5, F.unix_seconds("ts")
    return bar_trades(spark, d).select(
        "symbol", "ts", F.round(money.spread_pips(c("spread_typical"), c("point"), c("pip"), c("session"), ratio, money.cost_noise(F.lit("spread"), c("symbol"), at)), 6).alias("spread_pips"),
        F.round(money.slippage_pips(ratio, money.cost_noise(F.lit("slip"), c("symbol"), at)), 6).alias("slippage_pips"),
        F.round(money.leg_commission(F.lit(1.5), F.lit(7.0)), 4).alias("leg_commission"),
        F.round(money.quoted_spread_pips(c("low"), c("high"), c("pip")), 4).alias("quoted_pips"))


# ---- fills, outcomes, single position

_RUN = {"sl_atr_multiple": 1.5, "tp_rr_ratio": 2.0}
_FILLS = tsql.feats() + tsql.fills("donchian_breakout", 1.5, 2.0, CAPITAL)


def donchian_fills(spark, d):
    f = stage(ready(spark, d))
    s = signals.with_signals(f, "donchian_breakout", _RUN, reasons=False)
    return f, stage(trades.next_bar_fills(s, f, b.specs(spark), capital=CAPITAL))


@query("trade_next_bar_fills", _FILLS + """ SELECT symbol, signal_no, entry_no, direction, entry_time, round(entry_price, 6) AS entry_price, round(sl_price, 6) AS sl_price,
 round(tp_price, 6) AS tp_price, round(lots, 4) AS lots, round(lots * 3.5, 4) AS commission_open, session AS entry_session, regime AS entry_regime, round(rsi, 4) AS rsi, round(bb_pct, 4) AS bb_pct,
 round(atr, 4) AS volatility_atr, round(atr_ratio, 4) AS volatility_ratio, round(volume_rel, 4) AS volume_relative, hour(entry_time) AS hour_utc, isodow(entry_time) - 1 AS day_of_week FROM fills""")
def trade_next_bar_fills(spark, d):
    _, fills = donchian_fills(spark, d)
    fills = rounded(fills, ["entry_price", "sl_price", "tp_price"])
    fills = rounded(fills, ["lots", "commission_open", "rsi", "bb_pct", "volatility_atr", "volatility_ratio", "volume_relative"], 4)
    return fills.drop("signal_time", "ma_distance_ticks", "risk_pct")


@query("trade_barrier_outcomes", _FILLS + tsql.TOUCH + """ SELECT symbol, signal_no, entry_no, direction, touch_no, touch_reason, round(touch_price, 6) AS touch_price FROM touched""")
def trade_barrier_outcomes(spark, d):
    f, fills = donchian_fills(spark, d)
    out = trades.barrier_outcomes(fills, f, fan_out=8)
    return rounded(out.select("symbol", "signal_no", "entry_no", "direction", "touch_no", "touch_reason", "touch_price"), ["touch_price"])


_RESOLVED = _FILLS + tsql.TOUCH + tsql.resolved("rsi_reversion")


def resolved(spark, d):
    f, fills = donchian_fills(spark, d)
    flags = signals.with_exit_flags(f, "rsi_reversion", {})
    return f, trades.resolve_exits(trades.barrier_outcomes(fills, f), f, trades.next_exit_bars(flags))


@query("trade_resolved_exits", _RESOLVED + """ SELECT symbol, signal_no, direction, exit_no, exit_time, round(exit_price, 6) AS exit_price, close_reason, duration_candles, exit_session FROM resolved""")
def trade_resolved_exits(spark, d):
    _, r = resolved(spark, d)
    return rounded(r.select("symbol", "signal_no", "direction", "exit_no", "exit_time", "exit_price", "close_reason", "duration_candles", "exit_session"), ["exit_price"])


@query("trade_pnl", _RESOLVED + tsql.PNL + """ SELECT symbol, signal_no, round(gross_pnl, 4) AS gross_pnl, round(commission, 4) AS commission, round(swap_cost, 4) AS swap_cost, round(net_pnl, 4) AS net_pnl FROM pnl""")
def trade_pnl(spark, d):
    _, r = resolved(spark, d)
    cols = ["gross_pnl", "commission", "swap_cost", "net_pnl"]
    return rounded(trades.with_pnl(r, b.specs(spark)).select("symbol", "signal_no", *cols), cols, 4)


@query("trade_exit_costs", _RESOLVED + f""", x AS (SELECT r.*, g.atr_ratio AS xr FROM resolved r JOIN ff g ON g.symbol = r.symbol AND g.row_no = r.exit_no), c AS (SELECT *,
 0.3 * {tsql.vol('xr')} * {tsql.noise('exit_slip', 'symbol', 'exit_no')} * {tsql.PIP} AS xs, spread_typical * point / {tsql.PIP} * {tsql.sess('exit_session')} * {tsql.vol('xr')} * {tsql.noise('exit_spread', 'symbol', 'exit_no')} * {tsql.PIP} / 2 AS xh FROM x)
 SELECT symbol, signal_no, close_reason, round(exit_price - CASE direction WHEN 'BUY' THEN 1 ELSE -1 END * CASE close_reason WHEN 'TP_HIT' THEN 0 WHEN 'SL_HIT' THEN xs ELSE xh + xs END, 6) AS exit_price FROM c""")
def trade_exit_costs(spark, d):
    _, r = resolved(spark, d)
    return rounded(trades.with_pnl(r, b.specs(spark), apply_exit_costs=True).select("symbol", "signal_no", "close_reason", "exit_price"), ["exit_price"])


_SIM = _RESOLVED + tsql.PNL + tsql.KEPT


def simulated(spark, d):
    f = stage(ready(spark, d))
    return f, trades.simulate(f, b.specs(spark), "combo_donchian_breakout__rsi_reversion", _RUN, CAPITAL)


@query("trade_single_position", _SIM + """ SELECT symbol, signal_no, p.exit_no, direction, close_reason, round(net_pnl, 4) AS net_pnl FROM kept JOIN pnl p USING (symbol, signal_no)""")
def trade_single_position(spark, d):
    _, t = simulated(spark, d)
    return rounded(t.select("symbol", "signal_no", "exit_no", "direction", "close_reason", "net_pnl"), ["net_pnl"], 4)


_LATE = tsql.feats() + tsql.fills("donchian_breakout", 1.5, 2.0, CAPITAL, start="2024-01-12", reanchor=True) + tsql.TOUCH + tsql.resolved("rsi_reversion") + tsql.PNL + tsql.KEPT


@query("trade_run_from_start", _LATE + """ SELECT symbol, signal_no, p.exit_no, direction, close_reason, round(sl_price, 6) AS sl_price, round(tp_price, 6) AS tp_price, round(lots, 4) AS lots, round(net_pnl, 4) AS net_pnl
 FROM kept JOIN pnl p USING (symbol, signal_no)""")
def trade_run_from_start(spark, d):
    """A run that begins inside the history, with stops and targets moved to the fill."""
    t = trades.simulate(stage(ready(spark, d)), b.specs(spark), "combo_donchian_breakout__rsi_reversion", {**_RUN, "reanchor_sl_on_fill": True}, CAPITAL,
                        start=F.lit("2024-01-12").cast("timestamp"))
    out = t.select("symbol", "signal_no", "exit_no", "direction", "close_reason", "sl_price", "tp_price", "lots", "net_pnl")
    return rounded(rounded(out, ["sl_price", "tp_price"]), ["lots", "net_pnl"], 4)


@query("trade_mark_to_market", _SIM + """ SELECT t.symbol, f.row_no, f.ts, round(sum(CASE direction WHEN 'BUY' THEN 1 ELSE -1 END * (f.close - entry_price) / tick_size * lots * tick_value), 4) AS unrealised_pnl,
 count(*) AS open_trades FROM (SELECT p.* FROM kept JOIN pnl p USING (symbol, signal_no)) t JOIN ff f ON f.symbol = t.symbol AND f.row_no >= t.entry_no
 AND (f.row_no < t.exit_no OR (t.close_reason = 'END_OF_DATA' AND f.row_no = t.exit_no)) GROUP BY t.symbol, f.row_no, f.ts""")
def trade_mark_to_market(spark, d):
    f, t = simulated(spark, d)
    return rounded(trades.mark_to_market(t, f, b.specs(spark)), ["unrealised_pnl"], 4)


@query("trade_excursions", _SIM + """ SELECT t.symbol, t.signal_no, count(f.row_no) AS candles_open, round(greatest(t.entry_price, max(f.high)), 6) AS highest_price,
 round(least(t.entry_price, min(f.low)), 6) AS lowest_price FROM (SELECT p.* FROM kept JOIN pnl p USING (symbol, signal_no)) t LEFT JOIN ff f ON f.symbol = t.symbol AND f.row_no >= t.entry_no
 AND (f.row_no < t.exit_no OR (t.close_reason = 'END_OF_DATA' AND f.row_no = t.exit_no)) GROUP BY t.symbol, t.signal_no, t.entry_price""")
def trade_excursions(spark, d):
    f, t = simulated(spark, d)
    return rounded(trades.excursions(t, f, ["symbol", "signal_no"]), ["highest_price", "lowest_price"])


@query("trade_as_of_bar", b.with_sql("bars") + """ SELECT t.symbol, t.seq, t.ts, a.ts AS as_of_ts, a.close FROM ticks t ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 HOUR AS at, ts, close FROM bars) a
 ON t.symbol = a.symbol AND t.ts >= a.at""")
def trade_as_of_bar(spark, d):
    """Every tick with the last bar that had closed by then."""
    bars = b.bars(spark, d).withColumn("at", F.col("ts") + F.expr("INTERVAL 1 HOUR")).withColumnRenamed("ts", "bar_ts")
    left = b.ticks(spark, d).select("symbol", "seq", "ts")
    out = trades.as_of(left, bars, ["symbol"], "ts", "at", ["bar_ts", "close"], ["seq"])
    return out.select("symbol", "seq", "ts", F.col("bar_ts").alias("as_of_ts"), "close")


@query("trade_guard_flags", _SIM + """, x AS (SELECT symbol, row_no, CASE WHEN (rsi_prev < 50 AND rsi >= 50) OR (rsi_prev > 50 AND rsi <= 50) THEN 1 ELSE 0 END
 * CASE WHEN session = 'DEAD_ZONE' OR donchian_upper_entry IS NULL OR donchian_lower_entry IS NULL OR atr IS NULL OR close IS NULL THEN 0 ELSE 1 END AS m FROM ff),
 xs AS (SELECT *, sum(m) OVER (PARTITION BY symbol ORDER BY row_no) AS c FROM x),
 t AS (SELECT p.*, sum(p.net_pnl) OVER (PARTITION BY p.symbol, p.exit_time::DATE ORDER BY p.signal_no) AS day_sum, a.c AS at_signal, z.c - z.m AS at_exit FROM kept JOIN pnl p USING (symbol, signal_no)
  JOIN xs a ON a.symbol = p.symbol AND a.row_no = p.signal_no JOIN xs z ON z.symbol = p.symbol AND z.row_no = p.exit_no),
 u AS (SELECT *, min(day_sum) OVER (PARTITION BY symbol, exit_time::DATE ORDER BY signal_no) AS low FROM t),
 v AS (SELECT *, lag(exit_time::DATE) OVER w AS b_day, lag(low) OVER w AS b_low, lag(net_pnl) OVER w AS b_net, lag(direction) OVER w AS b_dir, lag(at_exit) OVER w AS b_cross FROM u WINDOW w AS (PARTITION BY symbol ORDER BY signal_no))
 SELECT symbol, signal_no, round(CASE WHEN b_day = signal_time::DATE THEN b_low END, 4) AS day_low, coalesce(b_net < 0 AND b_dir = direction AND at_signal <= b_cross, FALSE) AS side_lost FROM v""")
def trade_guard_flags(spark, d):
    """What a daily halt and a re-entry cooldown look at when a taken trade signals."""
    f, t = simulated(spark, d)
    marked = trades.with_guard_inputs(stage(t), f, signals.midline_crossed({}, "combo_donchian_breakout__rsi_reversion"))
    return rounded(paths.guard_columns(marked, ["symbol"]).select("symbol", "signal_no", "day_low", "side_lost"), ["day_low"], 4)


@query("flagship_ma_signals", b.with_sql("indexed") + f""", m AS (SELECT symbol, ts, close, row_no, {b.session_sql('ts')} AS session,
 CASE WHEN row_no >= 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY row_no ROWS 4 PRECEDING) END AS fast,
 CASE WHEN row_no >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY row_no ROWS 19 PRECEDING) END AS slow FROM indexed),
 p AS (SELECT *, lag(fast) OVER w AS fast_prev, lag(slow) OVER w AS slow_prev FROM m WINDOW w AS (PARTITION BY symbol ORDER BY row_no))
 SELECT symbol, ts, session, close, round(fast, 6) AS sma_fast, round(slow, 6) AS sma_slow, CASE WHEN fast > slow THEN 'BUY' ELSE 'SELL' END AS signal FROM p
 WHERE session <> 'DEAD_ZONE' AND ((fast_prev <= slow_prev AND fast > slow) OR (fast_prev >= slow_prev AND fast < slow))""")
def flagship_ma_signals(spark, d):
    """Ticks to hourly bars to moving-average crossings outside the dead zone."""
    from candlewick.functions import ordered
    from candlewick.functions.calendar import session_label
    rows = ordered.spread(b.indexed_bars(spark, d), 21)
    rows = rows.withColumn("sma_fast", ind.sma_col("close", 5)).withColumn("sma_slow", ind.sma_col("close", 20))
    rows = rows.withColumns({f"{c}_prev": ind.prev_col(c) for c in ("sma_fast", "sma_slow")})
    four = [F.col(c) for c in ("sma_fast", "sma_fast_prev", "sma_slow", "sma_slow_prev")]
    side = F.when(ind.crossed_above(*four), "BUY").when(ind.crossed_below(*four), "SELL")
    out = ordered.own_rows(rows.withColumn("session", session_label(F.col("ts"))).withColumn("signal", side))
    return rounded(out.filter("session <> 'DEAD_ZONE' AND signal IS NOT NULL").select(
        "symbol", "ts", "session", "close", "sma_fast", "sma_slow", "signal"), ["sma_fast", "sma_slow"])
