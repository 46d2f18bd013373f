"""From signals to costed trades: fills, barriers, exits, P&L, marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import money, ordered
from candlewick.functions.calendar import rollover_nights
from candlewick.functions.staging import stage
from candlewick.operators.indicators import ma_distance_ticks

SNAPSHOT = ["rsi", "bb_pct", "atr", "atr_ratio", "volume_rel"]
TOP_COPIES = 64


def next_bar_fills(signals: DataFrame, feats: DataFrame, specs: DataFrame, keys: Sequence[str] = (), risk_pct: float = 1.0,
                   capital: float = 10_000.0, commission_per_lot: float = money.COMMISSION_PER_LOT,
                   base_slippage: float = money.BASE_SLIPPAGE_PIPS, noise: bool = True, reanchor: bool = False) -> DataFrame:
    """Entries: a signal on bar i fills at the open of bar i+1, half the spread and the slippage worse.

    ``signals`` holds symbol, row_no, signal, close, sl_price, tp_price and any ``keys``. Session,
    volatility and the feature snapshot are those of the fill bar. Entries whose stop ends up on the
    wrong side of the fill, or whose size rounds to nothing, are dropped. ``specs`` is the instrument table; the
    optimizer broadcasts it when its size allows.
    """
    cand = (signals.filter(F.col("signal").isin("BUY", "SELL"))
            .select("symbol", *keys, F.col("row_no").alias("signal_no"), (F.col("row_no") + 1).alias("row_no"),
                    F.col("signal").alias("direction"), F.col("ts").alias("signal_time"), F.col("close").alias("signal_close"),
                    "sl_price", "tp_price"))
    bar = feats.select("symbol", "row_no", F.col("ts").alias("entry_time"), F.col("open").alias("fill_open"), "session",
                       "regime", "sma_fast", *SNAPSHOT)
    j = cand.join(bar, ["symbol", "row_no"]).join(specs, "symbol")
    pip = money.pip_size(F.col("digits"), F.col("point"))
    rnd = lambda tag: money.cost_noise(F.lit(tag), F.col("symbol"), F.col("row_no")) if noise else F.lit(1.0)
    half = money.spread_pips(F.col("spread_typical"), F.col("point"), pip, F.col("session"), F.col("atr_ratio"), rnd("spread")) * pip / 2
    slip = money.slippage_pips(F.col("atr_ratio"), rnd("slip"), base_slippage) * pip
    buy = money.is_buy(F.col("direction"))
    j = j.withColumn("entry_price", F.when(buy, F.col("fill_open") + half + slip).otherwise(F.col("fill_open") - half - slip))
    if reanchor:
        shift = F.col("entry_price") - F.col("signal_close")
        j = j.withColumn("sl_price", F.col("sl_price") + shift).withColumn("tp_price", F.col("tp_price") + shift)
    e, sl = F.col("entry_price"), F.col("sl_price")
    j = j.filter(F.when(buy, sl < e).otherwise(sl > e))
    lots = money.lots_for_risk(F.lit(capital), F.lit(risk_pct), F.abs(e - sl), F.col("tick_size"), F.col("tick_value"),
                               F.col("volume_min"), F.col("volume_step"), F.col("volume_max"))
    j = j.withColumn("lots", lots).filter("lots > 0")
    return j.select(
        "symbol", *keys, "signal_no", F.col("row_no").alias("entry_no"), "direction", "signal_time", "entry_time", "entry_price",
        "sl_price", "tp_price", "lots", F.lit(risk_pct).alias("risk_pct"),
        money.leg_commission(F.col("lots"), F.lit(commission_per_lot)).alias("commission_open"),
        F.col("session").alias("entry_session"), F.col("regime").alias("entry_regime"),
        F.col("rsi"), F.col("bb_pct"), F.col("atr").alias("volatility_atr"), F.col("atr_ratio").alias("volatility_ratio"),
        F.col("volume_rel").alias("volume_relative"),
        ma_distance_ticks(F.col("entry_price"), F.col("sma_fast"), F.col("tick_size")).alias("ma_distance_ticks"),
        F.hour("entry_time").alias("hour_utc"), F.weekday("entry_time").alias("day_of_week"))


# ---- barriers ---------------------------------------------------------------------------------

def _touches(low: Column, high: Column) -> Column:
    return (low <= F.col("_lo_level")) | (high >= F.col("_hi_level"))


def _first(arr: str, after: Column | None, result: str) -> Column:
    """Position of the first node in ``arr`` (beyond ``after``) that touches a barrier."""
    def ok(n):
        hit = _touches(n["low"], n["high"])
        return hit if after is None else hit & (n["no"] >= after)

    return F.get(F.filter(arr, ok), F.lit(0))[result]


def barrier_outcomes(entries: DataFrame, bars: DataFrame, fan_out: int = 64) -> DataFrame:
    """First bar from the entry bar on where stop or target is touched; the stop counts first.

    Adds touch_no, touch_time, touch_price, touch_reason (NULL if never touched). Bars are grouped
    ``fan_out`` at a time into blocks with their lowest low and highest high, blocks into larger ones
    and so on, three levels up. A search climbs from the entry block until some block touches and then
    descends into it, so it reads a few short arrays, however far away the touch is, and every
    array except the per-symbol top list has at most ``fan_out`` nodes. The top lists are repeated under ``TOP_COPIES``
    numbers, among which the entries of a symbol spread; entries that need no more search carry keys of their own.
    """
    f = fan_out
    node = lambda key, src: src.withColumn("_up", F.floor(F.col(key) / f))
    b = bars.select("symbol", (F.col("row_no") - 1).alias("no"), "ts", "open", "high", "low")
    arrays = []
    level = node("no", b)
    arrays.append(level.groupBy("symbol", "_up").agg(
        F.sort_array(F.collect_list(F.struct("no", "low", "high", "open", "ts"))).alias("_a")))
    for depth in range(3):
        level = level.groupBy("symbol", "_up").agg(F.min("low").alias("low"), F.max("high").alias("high")) \
            .withColumnRenamed("_up", "no")
        level = node("no", level) if depth < 2 else level.withColumn("_up", F.lit(0).cast("bigint"))
        arrays.append(level.groupBy("symbol", "_up").agg(F.sort_array(F.collect_list(F.struct("no", "low", "high"))).alias("_a")))
    copies = F.sequence(F.lit(0), F.lit(TOP_COPIES - 1)).cast("array<bigint>")
    arrays[3] = arrays[3].withColumn("_up", F.explode(copies))

    buy = money.is_buy(F.col("direction"))
    w = (entries.withColumn("_lo_level", F.when(buy, F.col("sl_price")).otherwise(F.col("tp_price")))
         .withColumn("_hi_level", F.when(buy, F.col("tp_price")).otherwise(F.col("sl_price")))
         .withColumn("_at0", F.col("entry_no") - 1).withColumn("_hit", F.lit(None).cast("struct<no:bigint,low:double,high:double,open:double,ts:timestamp>"))
         .withColumn("_b1", F.lit(None).cast("bigint")).withColumn("_b2", F.lit(None).cast("bigint")).withColumn("_b3", F.lit(None).cast("bigint")))
    for k in (1, 2, 3):
        w = w.withColumn(f"_at{k}", F.floor(F.col(f"_at{k - 1}") / f))

    def step(w: DataFrame, depth: int, where: Column, active: Column, after: Column | None, target: str) -> DataFrame:
        """Look into one node list per unresolved entry."""
        # node numbers are not negative, so a resolved entry meets nothing and none of its like
        probe = w.withColumn("_up", F.when(active, where).otherwise(-1 - F.col("entry_no")))
        seen = probe.join(arrays[depth], ["symbol", "_up"], "left")
        found = _first("_a", after, "no") if target != "_hit" else F.get(
            F.filter("_a", lambda n: _touches(n["low"], n["high"]) & (n["no"] >= after if after is not None else F.lit(True))), F.lit(0))
        return seen.withColumn(target, F.when(active & F.col("_a").isNotNull(), found).otherwise(F.col(target))).drop("_a", "_up")

    none = lambda *cols: [F.col(c).isNull() for c in cols]
    w = step(w, 0, F.col("_at1"), F.lit(True), F.col("_at0"), "_hit")
    w = step(w, 1, F.col("_at2"), none("_hit")[0], F.col("_at1") + 1, "_b1")
    w = step(w, 2, F.col("_at3"), none("_hit")[0] & none("_b1")[0], F.col("_at2") + 1, "_b2")
    w = step(w, 3, F.pmod(F.col("entry_no"), F.lit(TOP_COPIES)).cast("bigint"), none("_hit")[0] & none("_b1")[0] & none("_b2")[0], F.col("_at3") + 1, "_b3")
    w = step(w, 2, F.col("_b3"), F.col("_b3").isNotNull(), None, "_b2")
    w = step(w, 1, F.col("_b2"), F.col("_b2").isNotNull(), None, "_b1")
    w = step(w, 0, F.col("_b1"), F.col("_b1").isNotNull(), None, "_hit")
    hit = F.col("_hit")
    stopped = F.when(buy, hit["low"] <= F.col("sl_price")).otherwise(hit["high"] >= F.col("sl_price"))
    fill = F.when(buy, F.least("sl_price", hit["open"])).otherwise(F.greatest("sl_price", hit["open"]))
    return (w.withColumn("touch_no", hit["no"] + 1).withColumn("touch_time", hit["ts"])
            .withColumn("touch_reason", F.when(hit.isNotNull(), F.when(stopped, "SL_HIT").otherwise("TP_HIT")))
            .withColumn("touch_price", F.when(hit.isNotNull(), F.when(stopped, fill).otherwise(F.col("tp_price"))))
            .drop("_lo_level", "_hi_level", "_hit", *[f"_at{k}" for k in range(4)], "_b1", "_b2", "_b3"))


def next_exit_bars(flags: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """For every bar, the nearest bar at or after it whose exit flag is set, per side."""
    chunk = F.floor((F.col("row_no") - 1) / ordered.CHUNK_ROWS)
    return ordered.running(flags.select(*keys, "row_no", "buy_exit", "sell_exit"), keys, ["row_no"], chunk, {
        "next_buy_exit": ("min", F.when(F.col("buy_exit"), F.col("row_no"))),
        "next_sell_exit": ("min", F.when(F.col("sell_exit"), F.col("row_no")))}, descending=True
    ).select(*keys, "row_no", "next_buy_exit", "next_sell_exit")


def resolve_exits(touched: DataFrame, bars: DataFrame, exits: DataFrame | None = None, exit_keys: Sequence[str] = ("symbol",),
                  signal_reason: str = "EXIT_SIGNAL", last_no: Column | None = None) -> DataFrame:
    """The exit that comes first: barrier, signal exit at the next open, or the close of the last bar.

    ``exits`` is ``next_exit_bars`` output. ``last_no`` bounds the horizon (a window's last bar);
    without it the horizon is the symbol's last bar. Needs bars with ``session``.
    """
    t = touched
    if last_no is None:
        t = t.join(bars.groupBy("symbol").agg(F.max("row_no").alias("_last")), "symbol")
    else:
        t = t.withColumn("_last", last_no)
    if exits is not None:
        t = (t.join(exits.withColumnRenamed("row_no", "entry_no"), [*exit_keys, "entry_no"], "left")
             .withColumn("_flag", F.when(money.is_buy(F.col("direction")), F.col("next_buy_exit")).otherwise(F.col("next_sell_exit"))))
    else:
        t = t.withColumn("_flag", F.lit(None).cast("bigint"))
    by_touch = (F.col("touch_no") <= F.col("_last")) & (F.col("_flag").isNull() | (F.col("touch_no") <= F.col("_flag")))
    by_signal = F.col("_flag").isNotNull() & (F.col("_flag") < F.col("_last"))
    kind = F.when(F.coalesce(by_touch, F.lit(False)), F.col("touch_reason")).when(by_signal, signal_reason).otherwise("END_OF_DATA")
    no = F.when(F.coalesce(by_touch, F.lit(False)), F.col("touch_no")).when(by_signal, F.col("_flag") + 1).otherwise(F.col("_last"))
    t = t.withColumn("close_reason", kind).withColumn("exit_no", no)
    bar = bars.select("symbol", F.col("row_no").alias("exit_no"), F.col("ts").alias("exit_time"), F.col("open").alias("_xo"),
                      F.col("close").alias("_xc"), F.col("session").alias("exit_session"), F.col("atr_ratio").alias("exit_atr_ratio"))
    return (t.join(bar, ["symbol", "exit_no"])
            .withColumn("exit_price", F.when(F.col("close_reason").isin("SL_HIT", "TP_HIT"), F.col("touch_price"))
                        .when(F.col("close_reason") == "END_OF_DATA", F.col("_xc")).otherwise(F.col("_xo")))
            .withColumn("duration_candles", F.when(F.col("close_reason") == "END_OF_DATA", F.col("exit_no") - F.col("entry_no") + 1)
                        .otherwise(F.col("exit_no") - F.col("entry_no")))
            .drop("_last", "_flag", "_xo", "_xc", "next_buy_exit", "next_sell_exit", "touch_no", "touch_time", "touch_price", "touch_reason"))


def with_pnl(trades: DataFrame, specs: DataFrame, commission_per_lot: float = money.COMMISSION_PER_LOT,
             apply_exit_costs: bool = False, noise: bool = True, base_slippage: float = money.BASE_SLIPPAGE_PIPS) -> DataFrame:
    """Gross and net P&L with both commission legs and swap; optional costs on the exit side."""
    dims = ["symbol", "digits", "point", "tick_size", "tick_value", "spread_typical", "swap_long", "swap_short"]
    t = trades.join(specs.select(*dims), "symbol")
    side, lots, price = F.col("direction"), F.col("lots"), F.col("exit_price")
    if apply_exit_costs:
        pip = money.pip_size(F.col("digits"), F.col("point"))
        rnd = lambda tag: money.cost_noise(F.lit(tag), F.col("symbol"), F.col("exit_no")) if noise else F.lit(1.0)
        slip = money.slippage_pips(F.col("exit_atr_ratio"), rnd("exit_slip"), base_slippage) * pip
        half = money.spread_pips(F.col("spread_typical"), F.col("point"), pip, F.col("exit_session"), F.col("exit_atr_ratio"),
                                 rnd("exit_spread")) * pip / 2
        cost = F.when(F.col("close_reason") == "TP_HIT", F.lit(0.0)).when(F.col("close_reason") == "SL_HIT", slip).otherwise(half + slip)
        price = price - money.signed(side, cost)
    t = t.withColumn("exit_price", price)
    leg = money.leg_commission(lots, F.lit(commission_per_lot))
    nights = rollover_nights(F.col("entry_time"), F.col("exit_time"))
    return (t.withColumn("gross_pnl", money.gross_pnl(side, F.col("entry_price"), F.col("exit_price"), lots, F.col("tick_size"), F.col("tick_value")))
            .withColumn("commission", leg * 2)
            .withColumn("swap_cost", money.swap_cost(side, F.col("swap_long"), F.col("swap_short"), lots, nights))
            .withColumn("net_pnl", F.col("gross_pnl") - F.col("commission") + F.col("swap_cost"))
            .drop(*[c for c in dims if c != "symbol"]))


def open_bars(trades: DataFrame, bars: DataFrame, trade_cols: Sequence[str], block: int = 256) -> DataFrame:
    """Trades joined with the bars during which they are open (entry bar up to the bar before the exit).

    Equality on (symbol, block of bars) keeps it a hash join; a trade appears once per block it spans.
    """
    # a position closed with the data is still open at the last close
    last = F.when(F.col("close_reason") == "END_OF_DATA", F.col("exit_no") + 1).otherwise(F.col("exit_no"))
    spans = trades.withColumn("exit_no", last).select("symbol", *trade_cols, "entry_no", "exit_no").withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("entry_no") / block), F.floor(F.greatest(F.col("exit_no") - 1, F.col("entry_no")) / block))))
    b = bars.select("symbol", "row_no", "ts", "high", "low", "close", F.floor(F.col("row_no") / block).alias("_block"))
    return (b.join(spans, ["symbol", "_block"])
            .filter((F.col("row_no") >= F.col("entry_no")) & (F.col("row_no") < F.col("exit_no"))).drop("_block"))


def mark_to_market(trades: DataFrame, bars: DataFrame, specs: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Open P&L at every bar close, summed over the trades open at that close."""
    extra = [k for k in keys if k != "symbol"]
    o = open_bars(trades, bars, [*extra, "direction", "entry_price", "lots"]).join(
        specs.select("symbol", "tick_size", "tick_value"), "symbol")
    pnl = money.gross_pnl(F.col("direction"), F.col("entry_price"), F.col("close"), F.col("lots"), F.col("tick_size"), F.col("tick_value"))
    return o.groupBy(*keys, "row_no", "ts").agg(F.sum(pnl).alias("unrealised_pnl"), F.count(F.lit(1)).alias("open_trades"))


def excursions(trades: DataFrame, bars: DataFrame, trade_key: Sequence[str]) -> DataFrame:
    """Bars held and the highest and lowest price seen while open (the exit bar does not count)."""
    key = [k for k in trade_key if k != "symbol"]
    o = open_bars(trades, bars, [*key, "entry_price"])
    seen = o.groupBy("symbol", *key).agg(F.count(F.lit(1)).alias("candles_open"), F.max("high").alias("_hi"), F.min("low").alias("_lo"))
    return (trades.select("symbol", *key, "entry_price").join(seen, ["symbol", *key], "left")
            .select("symbol", *key, F.coalesce("candles_open", F.lit(0)).alias("candles_open"),
                    F.greatest("entry_price", "_hi").alias("highest_price"), F.least("entry_price", "_lo").alias("lowest_price")))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, payload: Sequence[str],
          tie: Sequence[str], chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Attach the latest right row at or before each left time.

    Union, then the last non-NULL payload in time order, carried across slices of time of about ``chunk_rows`` rows.
    ``tie`` are left columns that make the order of left rows total.
    """
    body = F.struct(*[F.col(c) for c in [right_ts, *payload]])
    r = right.select(*keys, F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), body.alias("_p"))
    l0 = left.select(*keys, F.col(left_ts).alias("_at"), F.lit(1).alias("_side"),
                     F.struct(*[c for c in left.columns if c not in keys]).alias("_row"), F.struct(*tie).alias("_tie"))
    both = ordered.time_slices(l0.unionByName(r, allowMissingColumns=True), keys, "_at", "_slice", chunk_rows)
    got = ordered.running(both, keys, ["_at", "_side", "_tie"], F.col("_slice"), {"_last": ("last", F.col("_p"))})
    return got.filter("_side = 1").select(*keys, "_row.*", F.col(f"_last.{right_ts}").alias("as_of_ts"),
                                          *[F.col(f"_last.{c}").alias(c) for c in payload])


def with_guard_inputs(taken: DataFrame, feats: DataFrame, crossed: Column) -> DataFrame:
    """Days and midline crossings that ``paths.guard_columns`` needs; ``crossed`` is a condition on the bars."""
    chunk = F.floor((F.col("row_no") - 1) / ordered.CHUNK_ROWS)
    count = ordered.running(feats.withColumn("_m", crossed.cast("int")), ["symbol"], ["row_no"], chunk, {"_x": ("sum", F.col("_m"))})
    return (taken.withColumns({"signal_day": F.to_date("signal_time"), "exit_day": F.to_date("exit_time")})
            .join(count.select("symbol", F.col("row_no").alias("signal_no"), F.col("_x").alias("cross_at_signal")), ["symbol", "signal_no"])
            .join(count.select("symbol", F.col("row_no").alias("exit_no"), (F.col("_x") - F.col("_m")).alias("cross_before_exit")), ["symbol", "exit_no"]))


# ---- the whole chain for one parameter set -----------------------------------------------------

def simulate(feats: DataFrame, specs: DataFrame, name: str, params: dict, capital: float = 10_000.0,
             start: Column | None = None, noise: bool = True, apply_exit_costs: bool = False, fan_out: int = 64) -> DataFrame:
    """Signals to single-position trades for one parameter set; bars before ``start`` only warm up."""
    from candlewick.operators import paths, signals

    # features feed signals, fills, barriers and exits: compute them once
    feats = stage(feats)
    seen = feats if start is None else feats.filter(F.col("ts") >= start)
    sig = signals.with_signals(seen, name, params, reasons=False)
    fills = next_bar_fills(sig, feats, specs, risk_pct=params.get("risk_per_trade_pct", 1.0), capital=capital,
                           commission_per_lot=params.get("commission_per_lot", money.COMMISSION_PER_LOT),
                           base_slippage=params.get("base_slippage_pips", money.BASE_SLIPPAGE_PIPS), noise=noise,
                           reanchor=params.get("reanchor_sl_on_fill", False))
    flags = signals.with_exit_flags(seen, name, params)
    out = resolve_exits(barrier_outcomes(stage(fills), feats, fan_out), feats, next_exit_bars(flags))
    costed = with_pnl(out, specs, params.get("commission_per_lot", money.COMMISSION_PER_LOT), apply_exit_costs, noise)
    taken = paths.one_position(stage(costed), ["symbol"])
    halt, cool = params.get("daily_loss_halt_pct") or 0.0, bool(params.get("cooldown_requires_midline", False))
    if not halt and not cool:
        return taken
    marked = with_guard_inputs(taken, feats, signals.midline_crossed(params, name))
    return paths.guarded(marked, ["symbol"], capital, F.lit(float(halt)), F.lit(cool)).select(*taken.columns)
