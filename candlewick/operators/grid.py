"""Parameter grids and their factored evaluation.

A grid of P parameter sets is not P runs over the bars. Indicators depend on a few periods, signals
on a few entry combinations, and outcomes on (signal, stop, target, exit rule). Each factor is
computed once for all bars; parameter sets then pick their trades by an equi-join on factor values,
and only the single-position rule and the metrics run per set.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.functions import money, ordered
from candlewick.functions.staging import stage
from candlewick.operators import indicators as ind
from candlewick.operators import mandate as mandates
from candlewick.operators import metrics, paths, scoring, signals, trades

# The search space of each template.
SPACES = {
    "ma_crossover": {
        "fast_ma_period": [5, 10, 15, 20], "slow_ma_period": [30, 50, 80, 100], "ma_type": ["SMA"],
        "sl_atr_multiple": [1.0, 1.5, 2.0], "tp_rr_ratio": [1.5, 2.0, 2.5], "adx_threshold": [0, 15, 20, 25, 30]},
    "rsi_reversion": {
        "rsi_period": [14], "rsi_oversold": [20, 25, 30, 35], "rsi_overbought": [65, 70, 75, 80], "exit_on_midline": [True, False],
        "sl_atr_multiple": [1.0, 1.5, 2.0], "tp_rr_ratio": [1.5, 2.0, 2.5], "adx_threshold": [0, 15, 20, 25, 30],
        "cooldown_requires_midline": [True, False], "daily_loss_halt_pct": [0.0, 1.5, 2.0, 2.5, 3.0]},
    "donchian_breakout": {
        "channel_period": [20, 40, 60, 80, 120], "exit_period": [5, 10, 20, 40], "sl_atr_multiple": [1.0, 1.5, 2.0],
        "tp_rr_ratio": [1.5, 2.0, 2.5, 3.0], "adx_threshold": [0, 15, 20, 25, 30]},
    "hybrid_confluence": {
        "slow_ma_period": [30, 50, 80, 100], "ma_type": ["SMA"], "rsi_period": [14], "rsi_oversold": [30, 40, 45],
        "rsi_overbought": [55, 60, 70], "adx_threshold": [0, 20, 25], "sl_atr_multiple": [1.5, 2.0], "tp_rr_ratio": [2.0, 2.5]},
}
FIXED = {"risk_per_trade_pct": 1.0, "exit_on_opposite_crossover": False, "warmup_candles": 250}
# pairs that must be strictly increasing
ORDERED = {"ma_crossover": ("fast_ma_period", "slow_ma_period"), "rsi_reversion": ("rsi_oversold", "rsi_overbought"),
           "donchian_breakout": ("exit_period", "channel_period")}
# parameters that decide where a template enters, and their values where a space does not name them
ENTRY_AXES = {"ma_crossover": ["fast_ma_period", "slow_ma_period", "ma_type"], "rsi_reversion": ["rsi_period", "rsi_oversold", "rsi_overbought"],
              "donchian_breakout": ["channel_period"], "hybrid_confluence": ["slow_ma_period", "ma_type", "rsi_period", "rsi_oversold", "rsi_overbought"]}
ENTRY_DEFAULTS = {"ma_type": "SMA", "rsi_period": 14}
# ``rule_period`` is the period of the exit rule where it is no entry parameter (the exit channel), else 0
EXIT_AXES = ["sl_atr_multiple", "tp_rr_ratio", "use_exit", "risk_per_trade_pct", "rule_period"]
# the switch of a template's exit rule and its default; a template without a switch always uses its rule
EXIT_SWITCH = {"ma_crossover": ("exit_on_opposite_crossover", False), "donchian_breakout": ("exit_on_opposite_crossover", False), "rsi_reversion": ("exit_on_midline", True)}
# entry parameters that an exit rule depends on
RULE_AXES = {"ma_crossover": ["fast_ma_period", "slow_ma_period", "ma_type"], "rsi_reversion": ["rsi_period"], "hybrid_confluence": ["rsi_period"], "donchian_breakout": []}
# parameters of a set that filter its signals or change its account, for every template
SET_FILTERS = ["adx_threshold", "allowed_sessions", "atr_ratio_min", "atr_ratio_max", "daily_loss_halt_pct", "cooldown_requires_midline"]
# Template pairs tried as combinations, and the filter settings tried on a candidate.
COMBINATIONS = [("ma_crossover", "rsi_reversion"), ("donchian_breakout", "rsi_reversion"), ("hybrid_confluence", "rsi_reversion")]
FILTER_SETTINGS = {
    "session": [{"allowed_sessions": ["LONDON", "LONDON_NY_OVERLAP", "NEW_YORK"]}, {"allowed_sessions": ["LONDON", "LONDON_NY_OVERLAP"]},
                {"allowed_sessions": ["NEW_YORK", "LONDON_NY_OVERLAP"]}],
    "adx_trend": [{"adx_min_threshold": 20}, {"adx_min_threshold": 25}],
    "volatility": [{"atr_ratio_min": 0.7, "atr_ratio_max": 1.5}, {"atr_ratio_min": 0.5, "atr_ratio_max": 1.3}],
}


def parameter_grid(spark: SparkSession, template: str, space: dict | None = None, base: DataFrame | None = None,
                   valid_only: bool = True) -> DataFrame:
    """All valid parameter sets of a template with their id in product order (literal, a few thousand rows).

    With ``base`` (for example one row per symbol) every base row gets the whole grid.
    """
    if space is None and template not in SPACES:
        raise ValueError(f"unknown template {template!r}")
    space = space or SPACES[template]
    out = spark.range(1).select() if base is None else base
    for name, values in space.items():
        out = out.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_i_{name}", name))
    place = F.lit(0)
    for name, values in space.items():
        place = place * len(values) + F.col(f"_i_{name}")
    out = out.withColumn("params_id", place.cast("bigint")).drop(*[f"_i_{n}" for n in space])
    if valid_only and template in ORDERED and all(c in space for c in ORDERED[template]):
        lo, hi = ORDERED[template]
        out = out.filter(F.col(lo) < F.col(hi))
    adx = F.col("adx_threshold") if "adx_threshold" in space else F.lit(0)
    return out.withColumns({**{k: F.lit(v) for k, v in FIXED.items() if k not in space}, "adx_threshold": adx, "adx_min_threshold": adx})


def check_space(template: str, space: dict) -> None:
    """Raise on a parameter that the evaluation of this template would not use."""
    rule = [EXIT_SWITCH[template][0]] if template in EXIT_SWITCH else []
    known = {*ENTRY_AXES[template], *rule, *SET_FILTERS, "sl_atr_multiple", "tp_rr_ratio", "risk_per_trade_pct", *(["exit_period"] if template == "donchian_breakout" else [])}
    if unknown := sorted(set(space) - known):
        raise ValueError(f"the evaluation of {template} does not use {', '.join(unknown)}")


def with_axes(sets: DataFrame, template: str, exit_template: str | None = None) -> DataFrame:
    """Sets with every entry and exit axis; those a set does not name get their defaults."""
    has, rule = set(sets.columns), exit_template or template
    new = {a: F.lit(v) for a, v in ENTRY_DEFAULTS.items() if a in ENTRY_AXES[template] and a not in has}
    if "use_exit" not in has:
        switch, default = EXIT_SWITCH.get(rule, (None, True))
        new["use_exit"] = F.col(switch) if switch in has else F.lit(default)
    new["risk_per_trade_pct"] = (F.col("risk_per_trade_pct") if "risk_per_trade_pct" in has else F.lit(FIXED["risk_per_trade_pct"])).cast("double")
    out = sets.withColumns(new)
    period = F.when(F.col("use_exit"), F.col("exit_period")).otherwise(0) if rule == "donchian_breakout" and "exit_period" in has else F.lit(0)
    return out.withColumn("rule_period", period.cast("int"))


def grid_size(spark: SparkSession, template: str, space: dict | None = None) -> DataFrame:
    return parameter_grid(spark, template, space).groupBy().agg(F.count(F.lit(1)).alias("grid_size"))


def coherence(sets: DataFrame, risk_capital: float = 10_000.0) -> DataFrame:
    """First reason a parameter set makes no sense; stop and size rules need ``mean_atr`` and instrument columns."""
    has = set(sets.columns)
    c = F.col
    reason = F.lit(None).cast("string")
    rules: list[tuple[Column, str]] = []
    if {"fast_ma_period", "slow_ma_period"} <= has:
        rules += [((c("fast_ma_period") <= 0) | (c("slow_ma_period") <= 0), "MA_PERIOD_NOT_POSITIVE"), (c("fast_ma_period") >= c("slow_ma_period"), "FAST_NOT_BELOW_SLOW")]
    if "sl_atr_multiple" in has:
        rules.append((c("sl_atr_multiple") <= 0, "STOP_NOT_POSITIVE"))
    if "tp_rr_ratio" in has:
        rules.append((c("tp_rr_ratio") <= 0, "TARGET_NOT_POSITIVE"))
    if {"mean_atr", "point", "stops_level"} <= has:
        known = c("mean_atr") > 0
        sl = F.coalesce(c("sl_atr_multiple"), F.lit(1.5)) * c("mean_atr")
        risk = F.coalesce(c("risk_per_trade_pct").cast("double"), F.lit(1.0)) if "risk_per_trade_pct" in has else F.lit(1.0)
        lots = money.lots_for_risk(F.lit(risk_capital), risk, sl, c("tick_size"), c("tick_value"), c("volume_min"), c("volume_step"), c("volume_max"))
        rules += [(known & (sl / c("point") < c("stops_level")), "STOP_BELOW_BROKER_MINIMUM"), (known & (lots == 0.0), "SIZE_ROUNDS_TO_ZERO")]
    for cond, text in reversed(rules):
        reason = F.when(cond, text).otherwise(reason)
    return sets.withColumn("incoherent_because", reason)


def entry_combos(template: str, space: dict | None = None) -> list[tuple]:
    """Distinct entry combinations of a space."""
    space = space or SPACES[template]
    axes = ENTRY_AXES[template]
    combos = itertools.product(*[space[a] if a in space or a not in ENTRY_DEFAULTS else [ENTRY_DEFAULTS[a]] for a in axes])
    if template in ORDERED and set(ORDERED[template]) <= set(axes):
        lo, hi = (axes.index(a) for a in ORDERED[template])
        return [c for c in combos if c[lo] < c[hi]]
    return list(combos)


def exit_combos(space: dict, template: str, exit_template: str | None = None) -> list[tuple]:
    """Distinct combinations of the exit axes."""
    rule = exit_template or template
    switch, default = EXIT_SWITCH.get(rule, (None, True))
    periods = space.get("exit_period", [0]) if rule == "donchian_breakout" else [0]
    every = itertools.product(space["sl_atr_multiple"], space["tp_rr_ratio"], space.get(switch, [default]), space.get("risk_per_trade_pct", [FIXED["risk_per_trade_pct"]]), periods)
    return list(dict.fromkeys((sl, tp, use, float(risk), n if use else 0) for sl, tp, use, risk, n in every))


def _values(template: str, combos: Sequence[tuple], axis: str) -> list:
    axes = ENTRY_AXES[template]
    return sorted({c[axes.index(axis)] for c in combos}) if axis in axes else []


def _averages(template: str, combos: Sequence[tuple]) -> list[tuple[str, int]]:
    """(type, period) of every moving average the combinations use."""
    axes = ENTRY_AXES[template]
    if "ma_type" not in axes:
        return []
    kind = axes.index("ma_type")
    return sorted({(c[kind], c[axes.index(a)]) for c in combos for a in ("fast_ma_period", "slow_ma_period") if a in axes})


def grid_features(indexed: DataFrame, template: str, combos: Sequence[tuple], exit_periods: Sequence[int] = ()) -> DataFrame:
    """Features with one column per distinct average (``sma_n``, ``ema_n``), RSI (``rsi_n``) and channel (``upper_n``,
    ``lower_n``). Plain averages and channels share one set of chunks; every other EMA and RSI has its own."""
    averages, rsis = _averages(template, combos), _values(template, combos, "rsi_period")
    chans = sorted({*_values(template, combos, "channel_period"), *[n for n in exit_periods if n > 0]})
    base = ENTRY_DEFAULTS["rsi_period"]
    feats = ind.with_warmup_defaults(ind.features(indexed, {"rsi_period": base}))
    for kind, n in averages:
        if kind not in ("SMA", "EMA"):
            raise ValueError(f"unknown kind of moving average {kind!r}")
        if kind == "EMA":
            feats = ind.ema(feats, n, out=f"ema_{n}")
    for n in rsis:
        feats = feats.withColumns({f"rsi_{n}": F.col("rsi"), f"rsi_{n}_prev": F.col("rsi_prev")}) if n == base else ind.rsi(feats, n, out=f"rsi_{n}")
    own_rsi = [n for n in rsis if n != base]
    plain = [n for kind, n in averages if kind == "SMA"]
    if not averages and not chans and not own_rsi:
        return feats
    rows = ordered.spread(feats, max([*plain, *chans, 1]) + 2)
    rows = rows.withColumns({f"sma_{n}": ind.sma_col("close", n) for n in plain} | {
        k: v for n in chans for k, v in ind.donchian_cols(n, f"upper_{n}", f"lower_{n}").items()})
    rows = rows.withColumns({f"{kind.lower()}_{n}_prev": ind.prev_col(f"{kind.lower()}_{n}") for kind, n in averages} | {f"rsi_{n}_prev": ind.prev_col(f"rsi_{n}") for n in own_rsi})
    calm = ind.WARMUP_DEFAULTS["rsi"]
    return ordered.own_rows(rows.withColumns({c: ind.finite_or(F.col(c), calm) for n in own_rsi for c in (f"rsi_{n}", f"rsi_{n}_prev")}))


def _inputs(at: dict) -> list[Column]:
    """The feature columns of one combination under the names the templates read, with a leading underscore."""
    cols = []
    for role, a in (("sma_fast", "fast_ma_period"), ("sma_slow", "slow_ma_period")):
        if a in at:
            name = f"{at['ma_type'].lower()}_{at[a]}"
            cols += [F.col(name).alias(f"_{role}"), F.col(f"{name}_prev").alias(f"_{role}_prev")]
    if "rsi_period" in at:
        cols += [F.col(f"rsi_{at['rsi_period']}{end}").alias(f"_rsi{end}") for end in ("", "_prev")]
    for role, a in (("entry", "channel_period"), ("exit", "rule_period")):
        if a in at:
            cols += [F.col(f"{side}_{at[a]}").alias(f"_donchian_{side}_{role}") for side in ("upper", "lower")]
    return cols


def _per_combo(feats: DataFrame, combos: Sequence[dict], keep: Sequence[str]) -> DataFrame:
    """Every bar once per combination: its parameters and the columns that ``_inputs`` picks for it."""
    base = feats.withColumn("_e", F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in at.items()], *_inputs(at)) for at in combos])))
    names = base.schema["_e"].dataType.fieldNames()
    taken = {n.removeprefix("_") for n in names}
    return base.select(*[c for c in keep if c not in taken], *[F.col(f"_e.{n}").alias(n.removeprefix("_")) for n in names])


def entry_signals(feats: DataFrame, template: str, combos: Sequence[tuple]) -> DataFrame:
    """Signal bars of every entry combination, before session, ADX and volatility filters."""
    axes = ENTRY_AXES[template]
    keep = ["symbol", "row_no", "ts", "close", "atr", "adx", "session", "atr_ratio", "rsi", "rsi_prev", "sma_fast", "sma_fast_prev",
            "sma_slow", "sma_slow_prev"]
    picked = _per_combo(feats.filter("session <> 'DEAD_ZONE'"), [dict(zip(axes, c, strict=True)) for c in combos], keep)
    params = {a: F.col(a) for a in axes} | {"adx_threshold": 0}
    sig = signals.with_signals(picked, template, params, reasons=False)
    return sig.filter("signal <> 'HOLD'").select("symbol", *axes, "row_no", "ts", "signal", "close", "atr", "adx", "session", "atr_ratio")


def exit_bars(feats: DataFrame, template: str, exit_template: str | None, combos: Sequence[tuple], exits: Sequence[tuple]) -> tuple[DataFrame, list[str]]:
    """For every bar and setting of the exit rule, the next bar it would close a long or a short; and the setting's columns."""
    rule, axes = exit_template or template, ENTRY_AXES[template]
    keep = ["symbol", "row_no", "close", "session", "rsi", "rsi_prev", "sma_fast", "sma_fast_prev", "sma_slow", "sma_slow_prev"]
    if rule == "donchian_breakout":
        keys = ["rule_period"]
        settings = [{"rule_period": n} for n in sorted({e[4] for e in exits if e[2]})]
    else:
        # a rule whose parameters the entries do not have runs on its defaults
        keys = RULE_AXES[rule] if set(RULE_AXES[rule]) <= set(axes) else []
        settings = [dict(zip(keys, c, strict=True)) for c in dict.fromkeys(tuple(c[axes.index(a)] for a in keys) for c in combos)]
    rows = _per_combo(feats, settings, keep) if keys else feats.select(*keep)
    switch = {EXIT_SWITCH[rule][0]: True} if rule in EXIT_SWITCH else {}
    return trades.next_exit_bars(signals.with_exit_flags(rows, rule, switch), ["symbol", *keys]), keys


def outcomes(sig: DataFrame, feats: DataFrame, specs: DataFrame, template: str, exits: Sequence[tuple], exit_template: str | None = None,
             capital: float = 10_000.0, noise: bool = True, fan_out: int = 64, combos: Sequence[tuple] = ()) -> DataFrame:
    """Fill, barrier touch and next signal exit of every (signal, combination of the exit axes).

    ``exits`` may leave out the last axes (risk and rule period). ``combos`` are the entry combinations of ``sig``;
    an exit rule that depends on entry parameters needs them.
    """
    exits = [(*e, *(float(FIXED["risk_per_trade_pct"]), 0)[len(e) - 3:]) for e in exits]
    axes = [*ENTRY_AXES[template], *EXIT_AXES]
    ex = F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(EXIT_AXES, e, strict=True)]) for e in exits]))
    s = sig.withColumn("_x", ex).select("symbol", *ENTRY_AXES[template], "row_no", "ts", "signal", "close", "atr", "adx", "session", "atr_ratio", "_x.*")
    stop = F.col("atr") * F.col("sl_atr_multiple")
    sgn = F.when(F.col("signal") == "BUY", 1.0).otherwise(-1.0)
    s = s.withColumn("sl_price", F.col("close") - sgn * stop).withColumn("tp_price", F.col("close") + sgn * stop * F.col("tp_rr_ratio"))
    # what the set filters test at the signal bar travels with the fill
    gate = ["adx", "session", "atr_ratio"]
    s = s.withColumns({f"signal_{g}": F.col(g) for g in gate})
    carried = [*axes, *[f"signal_{g}" for g in gate]]
    fills = trades.next_bar_fills(s, feats, specs, keys=carried, risk_pct=F.col("risk_per_trade_pct"), capital=capital, noise=noise)
    touched = trades.barrier_outcomes(stage(fills), feats, fan_out)
    if not any(e[2] for e in exits):
        return touched.withColumn("flag_no", F.lit(None).cast("bigint"))
    nxt, keys = exit_bars(feats, template, exit_template, combos, exits)
    t = touched.join(nxt.withColumnRenamed("row_no", "entry_no"), ["symbol", *keys, "entry_no"], "left")
    flag = F.when(money.is_buy(F.col("direction")), F.col("next_buy_exit")).otherwise(F.col("next_sell_exit"))
    return t.withColumn("flag_no", F.when(F.col("use_exit"), flag)).drop("next_buy_exit", "next_sell_exit")


def pick_trades(out: DataFrame, feats: DataFrame, specs: DataFrame, template: str, sets: DataFrame, spans: DataFrame,
                set_key: str = "params_id", capital: float = 10_000.0, warmup: int = 250, block: int = 1024, exit_template: str | None = None) -> DataFrame:
    """Trades of every (symbol, span, parameter set): filters, horizon, P&L, single position.

    ``spans``: symbol, span_id, start_no, end_no (row numbers, end exclusive). ``sets``: the set key,
    entry and exit axes, adx_threshold, and optionally allowed_sessions, atr_ratio_min/max,
    daily_loss_halt_pct, cooldown_requires_midline. A ``symbol`` or ``span_id`` column in ``sets``
    restricts a set to that symbol or span.
    """
    sets = with_axes(sets, template, exit_template)
    scope = [c for c in ("symbol", "span_id") if c in sets.columns]
    axes = [*scope, *ENTRY_AXES[template], *EXIT_AXES]
    has = set(sets.columns)
    cut = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_no") / block), F.floor(F.col("end_no") / block))))
    inside = (out.withColumn("_block", F.floor(F.col("signal_no") / block)).join(cut, ["symbol", "_block"])
              .filter((F.col("signal_no") >= F.col("start_no")) & (F.col("entry_no") < F.col("end_no")) & (F.col("signal_no") > warmup)).drop("_block"))
    last = F.col("end_no") - 1
    touch = F.when((F.col("touch_no") <= last) & (F.col("flag_no").isNull() | (F.col("touch_no") <= F.col("flag_no"))), F.col("touch_no"))
    by_flag = F.col("flag_no") < last
    inside = (inside.withColumn("close_reason", F.when(touch.isNotNull(), F.col("touch_reason")).when(by_flag, "EXIT_SIGNAL").otherwise("END_OF_DATA"))
              .withColumn("exit_no", F.when(touch.isNotNull(), touch).when(by_flag, F.col("flag_no") + 1).otherwise(last)))
    bar = feats.select("symbol", F.col("row_no").alias("exit_no"), F.col("ts").alias("exit_time"), F.col("open").alias("_o"), F.col("close").alias("_c"))
    priced = inside.join(bar, ["symbol", "exit_no"]).withColumn("exit_price", F.when(F.col("close_reason").isin("SL_HIT", "TP_HIT"), F.col("touch_price"))
                                                               .when(F.col("close_reason") == "END_OF_DATA", F.col("_c")).otherwise(F.col("_o"))).drop("_o", "_c")
    costed = trades.with_pnl(priced, specs)
    guards = [c for c in ("daily_loss_halt_pct", "cooldown_requires_midline") if c in has]
    plain = [*axes, *[c for c in SET_FILTERS if c in has and c not in guards]]
    s = sets.select(set_key, *[F.col(c) for c in plain], *guards)
    run = set_key
    if guards:
        # guards filter a path: sets that differ in nothing else share it
        run = "_path"
        s = s.withColumn(run, F.min(set_key).over(Window.partitionBy(*plain)))
    picked = costed.join(s.select(run, *plain).distinct() if guards else s, axes)
    ok = (F.col("adx_threshold") <= 0) | (F.col("signal_adx") >= F.col("adx_threshold"))
    if "allowed_sessions" in has:
        ok = ok & (F.col("allowed_sessions").isNull() | F.array_contains("allowed_sessions", F.col("signal_session")))
    for name, cond in (("atr_ratio_min", lambda v: F.col("signal_atr_ratio") >= v), ("atr_ratio_max", lambda v: F.col("signal_atr_ratio") <= v)):
        if name in has:
            ok = ok & F.coalesce(cond(F.col(name).cast("double")), F.lit(True))
    keys = ["symbol", "span_id", run]
    want = [*keys, "signal_no", "entry_no", "exit_no", "direction", "entry_time", "exit_time", "lots", "net_pnl", "close_reason"]
    cand = picked.filter(ok)
    if guards:
        want = [*want, "signal_time"]
    taken = paths.one_position(stage(cand.select(*want)), keys)
    if not guards:
        return taken
    marked = paths.guard_columns(trades.with_guard_inputs(taken, feats, signals.midline_crossed({}, template)), keys)
    halt, cool = (F.col(c) if c in has else F.lit(v) for c, v in (("daily_loss_halt_pct", 0.0), ("cooldown_requires_midline", False)))
    return paths.let_through(marked.join(s.select(set_key, *scope, *guards, run), [*scope, run]), capital, halt, cool).drop(run)


def score_trades(picked: DataFrame, spans: DataFrame, set_key: str, capital: float, mandate: dict | None = None, min_trades: int = 10,
                 allow_partial: bool = True) -> DataFrame:
    """Metrics and quick score per (symbol, span, set); a breached mandate scores 0."""
    keys = ["symbol", "span_id", set_key]
    bounded = stage(picked.join(spans.select("symbol", "span_id", F.col("start").alias("_from"), F.col("end").alias("_to")), ["symbol", "span_id"]))
    chunk = ordered.chunk_unless_small(bounded, keys, F.floor(F.col("exit_no") / ordered.CHUNK_ROWS))
    order = ["exit_no", "signal_no"]
    m = metrics.summary(bounded, keys, order, chunk, capital, window=("_from", "_to"))
    limit = 8.0 if mandate is None else float(mandate["max_overall_drawdown_pct"])
    if mandate is None:
        return m.withColumn("score", scoring.quick_score(min_trades, limit, allow_partial))
    ok = mandates.first_breach(mandates.trade_points(bounded, keys, order, chunk, capital, mandate), keys, order, mandate)
    m = m.join(ok.select(*keys, "compliant", "breach_reason"), keys)
    return m.withColumn("score", scoring.quick_score(min_trades, limit, allow_partial, compliant=F.col("compliant")))


def best_per_span(scored: DataFrame, set_key: str = "params_id") -> DataFrame:
    """The best positive score per symbol and span; the lowest set id wins ties."""
    w = Window.partitionBy("symbol", "span_id").orderBy(F.desc("score"), set_key)
    return scored.filter(F.col("score") > 0).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def top_sets(scored: DataFrame, keys: Sequence[str], n: int, set_key: str = "params_id") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), set_key)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
