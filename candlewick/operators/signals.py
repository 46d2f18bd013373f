"""Strategy templates as columns over a feature table.

A template supplies an entry side, the inputs it needs, and an exit condition. Parameters are plain
values or columns, so one parameter set and a whole grid use the same code. Register a template with
``register`` to add a rule of your own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.operators.indicators import crossed_above, crossed_below

Params = dict


def param(params: Params, name: str, default=None) -> Column:
    value = params.get(name, default)
    return value if isinstance(value, Column) else F.lit(value)


def adx_threshold(params: Params, default: float = 0) -> Column:
    return param(params, "adx_threshold", params.get("adx_min_threshold", default))


@dataclass(frozen=True)
class Template:
    name: str
    needs: Sequence[str]
    side: Callable[[Params], tuple[Column, Column]]
    exits: Callable[[Params], tuple[Column, Column, str, str]]
    reasons: Callable[[Params], tuple[Column, Column]]
    idle: str
    own_adx_rule: bool = False
    adx_default: float = 0
    stop_default: float = 1.5


_REGISTRY: dict[str, Template] = {}


def register(template: Template) -> Template:
    _REGISTRY[template.name] = template
    return template


def _fmt(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *cols)


def _num(c: Column) -> Column:
    """Threshold as text: whole numbers without a fraction."""
    d = c.cast("double")
    return F.when(d == F.floor(d), d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def _ma_columns():
    return [F.col(c) for c in ("sma_fast", "sma_fast_prev", "sma_slow", "sma_slow_prev")]


def _opposite_cross(p: Params):
    on = param(p, "exit_on_opposite_crossover", False)
    return (on & crossed_below(*_ma_columns()), on & crossed_above(*_ma_columns()),
            "EXIT_OPPOSITE_CROSSOVER", "EXIT_OPPOSITE_CROSSOVER")


def _midline_level(p: Params):
    on = param(p, "exit_on_midline", True)
    return on & (F.col("rsi") >= 50.0), on & (F.col("rsi") <= 50.0), "EXIT_RSI_MIDLINE", "EXIT_RSI_MIDLINE"


def _opposite_channel(p: Params):
    on = param(p, "exit_on_opposite_crossover", False)
    known = F.col("donchian_lower_exit").isNotNull() & F.col("donchian_upper_exit").isNotNull()
    return (on & known & (F.col("close") < F.col("donchian_lower_exit")),
            on & known & (F.col("close") > F.col("donchian_upper_exit")), "EXIT_OPPOSITE_CHANNEL", "EXIT_OPPOSITE_CHANNEL")


def _midline_cross(p: Params):
    prev, now = F.col("rsi_prev"), F.col("rsi")
    return ((prev >= 50) & (now < 50), (prev <= 50) & (now > 50),
            "EXIT_RSI_MIDLINE_CROSS_DOWN", "EXIT_RSI_MIDLINE_CROSS_UP")


def _band_recross(p: Params, lo_default: float = 30, hi_default: float = 70):
    lo, hi = param(p, "rsi_oversold", lo_default), param(p, "rsi_overbought", hi_default)
    prev, now = F.col("rsi_prev"), F.col("rsi")
    return (prev < lo) & (now >= lo), (prev > hi) & (now <= hi)


def _hybrid_side(p: Params):
    up, down = _band_recross(p)
    strong = F.col("adx") >= adx_threshold(p, 20)
    return (F.col("close") > F.col("sma_slow")) & strong & up, (F.col("close") < F.col("sma_slow")) & strong & down


def _code(code: str, **values: Column) -> Column:
    """A reason: its code, then the values it rests on as name=value."""
    shown = [F.concat(F.lit(f"{n}="), F.format_string("%.5f", v.cast("double"))) for n, v in values.items()]
    return F.concat_ws(" ", F.lit(code), *shown)


def _sides(code: str, columns: Sequence[str], low: Callable[[Params], Column] | None = None, high: Callable[[Params], Column] | None = None):
    """Reasons of a long and a short entry over the same columns, with the level each had to pass."""
    def reasons(p: Params) -> tuple[Column, Column]:
        shown = {n: F.col(n) for n in columns}
        return tuple(_code(f"{code}_{side}", **shown, **({"level": level(p)} if level else {})) for side, level in (("long", low), ("short", high)))

    return reasons


def _oversold(p: Params) -> Column:
    return param(p, "rsi_oversold", 30)


def _overbought(p: Params) -> Column:
    return param(p, "rsi_overbought", 70)


NO_ENTRY = "no_entry"

register(Template(
    "ma_crossover", ("sma_fast", "sma_slow", "atr", "close"),
    lambda p: (crossed_above(*_ma_columns()), crossed_below(*_ma_columns())), _opposite_cross, _sides("ma_cross", ("sma_fast", "sma_slow")), NO_ENTRY))
register(Template(
    "rsi_reversion", ("rsi", "rsi_prev", "atr", "close"), _band_recross, _midline_level, _sides("rsi_return", ("rsi_prev", "rsi"), _oversold, _overbought), NO_ENTRY))
register(Template(
    "donchian_breakout", ("donchian_upper_entry", "donchian_lower_entry", "atr", "close"),
    lambda p: (F.col("close") > F.col("donchian_upper_entry"), F.col("close") < F.col("donchian_lower_entry")), _opposite_channel,
    _sides("channel_break", ("close",), lambda p: F.col("donchian_upper_entry"), lambda p: F.col("donchian_lower_entry")), NO_ENTRY))
register(Template(
    "hybrid_confluence", ("close", "sma_slow", "rsi", "rsi_prev", "adx", "atr"), _hybrid_side, _midline_cross,
    _sides("trend_and_rsi", ("close", "sma_slow", "adx", "rsi_prev", "rsi"), _oversold, _overbought), NO_ENTRY, own_adx_rule=True, adx_default=20, stop_default=2.0))


def parse_combo(name: str) -> tuple[str, str] | None:
    """(entry, exit) of ``combo_<entry>__<exit>`` or the older single-underscore form; None if no combo."""
    if not isinstance(name, str) or not name.startswith("combo_"):
        return None
    body = name.removeprefix("combo_")
    pairs = [(e, x) for e in _REGISTRY for x in _REGISTRY if body in (f"{e}__{x}", f"{e}_{x}")]
    if not pairs:
        raise ValueError(f"invalid combination template {name!r}")
    return pairs[0]


def template(name: str) -> tuple[Template, Template]:
    """Entry and exit template of a name; the same one twice unless it is a combination."""
    entry, exit_ = parse_combo(name) or (name, name)
    if entry not in _REGISTRY or exit_ not in _REGISTRY:
        raise ValueError(f"unknown strategy template {name!r}")
    return _REGISTRY[entry], _REGISTRY[exit_]


def _first_code(rules: Sequence[tuple[str, Column, dict[str, Column]]]) -> Column:
    """The code of the first rule that holds, with the values it rests on; NULL if none does. A rule that cannot be decided does not hold."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(holds, F.concat_ws(" ", F.lit(code), *[F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in shown.items()]))
                                                    for code, holds, shown in rules])


def block_reason(params: Params) -> Column:
    """Why no entry is allowed on a bar: dead zone, session list, ATR-ratio band. NULL = allowed."""
    session, ratio = F.col("session"), F.col("atr_ratio")
    rules = [("closed_hours", session == "DEAD_ZONE", {})]
    allowed = params.get("allowed_sessions")
    if allowed is not None:
        listed = allowed if isinstance(allowed, Column) else F.array(*[F.lit(s) for s in allowed]).cast("array<string>")
        rules.append(("unlisted_session", (F.size(listed) > 0) & ~F.array_contains(listed, session), {"session": session}))
    for name, code, beyond in (("atr_ratio_min", "quiet", lambda limit: ratio < limit), ("atr_ratio_max", "wild", lambda limit: ratio > limit)):
        if params.get(name) is not None:
            limit = param(params, name).cast("double")
            rules.append((f"{code}_market", beyond(limit), {"atr_ratio": F.round(ratio, 5), "limit": limit}))
    return _first_code(rules)


def adx_block(params: Params, live: bool = False) -> Column:
    """Why the trend filter stops an entry; ``live`` lets a missing ADX pass."""
    limit, adx = adx_threshold(params), F.col("adx")
    weak = ("weak_trend", (limit > 0) & (adx < limit), {"adx": F.round(adx, 5), "limit": limit.cast("double")})
    unknown = ("unknown_trend", (limit > 0) & adx.isNull(), {"limit": limit.cast("double")})
    return _first_code([weak] if live else [unknown, weak])


def _missing(names: Sequence[str]) -> Column:
    return _first_code([("missing_input", F.col(n).isNull() | F.isnan(n), {"name": F.lit(n)}) for n in names])


def with_signals(feats: DataFrame, name: str, params: Params, pip: Column | None = None, live: bool = False,
                 reasons: bool = True) -> DataFrame:
    """Add signal, reason, sl_price, tp_price, sl_pips, rr_ratio, confidence.

    ``live`` follows the live evaluation: session rules come first for every template, and a missing
    ADX does not block a moving-average crossover.
    """
    t, _ = template(name)
    up, down = t.side(params)
    is_ma = t.name == "ma_crossover"
    adx_stop = F.lit(None).cast("string") if t.own_adx_rule else adx_block(params, live and is_ma)
    order = [block_reason(params), _missing(t.needs)] if live else [_missing(t.needs), block_reason(params)]
    order.append(adx_stop)
    if live and is_ma:
        order.append(F.when(F.col("sma_fast_prev").isNull() | F.col("sma_slow_prev").isNull(), "no_previous_bar"))
    blocked = F.coalesce(*order)
    signal = F.when(blocked.isNotNull(), "HOLD").when(up, "BUY").when(down, "SELL").otherwise("HOLD")
    stop = F.col("atr") * param(params, "sl_atr_multiple", t.stop_default)
    rr = param(params, "tp_rr_ratio", 2.0).cast("double")
    buy = F.col("signal") == "BUY"
    active = F.col("signal") != "HOLD"
    pip = F.lit(0.0001) if pip is None else pip
    high = F.lit(True) if t.own_adx_rule else adx_threshold(params) == 0
    out = feats.withColumn("signal", signal)
    if reasons:
        bull, bear = t.reasons(params)
        out = out.withColumn("reason", F.when(F.col("signal") == "BUY", bull).when(F.col("signal") == "SELL", bear)
                             .otherwise(F.coalesce(blocked, F.lit(t.idle))))
    return (out.withColumn("sl_price", F.when(active, F.when(buy, F.col("close") - stop).otherwise(F.col("close") + stop)))
            .withColumn("tp_price", F.when(active, F.when(buy, F.col("close") + stop * rr).otherwise(F.col("close") - stop * rr)))
            .withColumn("sl_pips", F.when(active, stop / pip)).withColumn("rr_ratio", F.when(active, rr))
            .withColumn("confidence", F.when(active, F.when(high, "HIGH").otherwise("MEDIUM"))))


def with_exit_flags(feats: DataFrame, name: str, params: Params, gate_dead_zone: bool = True) -> DataFrame:
    """Add buy_exit / sell_exit: an open position of that side would be closed at the next open."""
    _, t = template(name)
    b, s, _, _ = t.exits(params)
    awake = (F.col("session") != "DEAD_ZONE") if gate_dead_zone else F.lit(True)
    return (feats.withColumn("buy_exit", awake & F.coalesce(b, F.lit(False)))
            .withColumn("sell_exit", awake & F.coalesce(s, F.lit(False))))


def midline_crossed(params: Params, name: str) -> Column:
    """RSI crossed 50 on a bar where entries are evaluated (feeds the re-entry cooldown)."""
    prev, now = F.col("rsi_prev"), F.col("rsi")
    crossed = ((prev < 50) & (now >= 50)) | ((prev > 50) & (now <= 50))
    t, _ = template(name)
    blocked = F.coalesce(_missing(t.needs), block_reason(params), adx_block(params))
    return F.coalesce(crossed, F.lit(False)) & blocked.isNull()


def latest(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The newest row per key."""
    top = df.groupBy(*keys).agg(F.max("row_no").alias("row_no"))
    return df.join(top, [*keys, "row_no"])


def live_exits(positions: DataFrame, latest_features: DataFrame, name: str, params: Params) -> DataFrame:
    """Open positions (symbol, direction, ...) against the newest bar: should_exit and reason.

    A plain moving-average crossover has no exit rule of its own on the live side.
    """
    _, t = template(name)
    joined = positions.join(latest_features, "symbol", "left")
    if parse_combo(name) is None and name == "ma_crossover":
        return joined.withColumn("should_exit", F.lit(False)).withColumn("exit_reason", F.lit(None).cast("string"))
    b, s, b_text, s_text = t.exits(params)
    buy = F.col("direction") == "BUY"
    hit = F.coalesce(F.when(buy, b).otherwise(s), F.lit(False))
    return (joined.withColumn("should_exit", hit)
            .withColumn("exit_reason", F.when(hit, F.when(buy, b_text).otherwise(s_text))))


# ---- pre-trade checks --------------------------------------------------------------------------

def _free_session() -> Column:
    named = F.col("allowed_sessions")
    any_session = named.isNull() | (F.size(named) == 0)
    return (F.col("session") != "DEAD_ZONE") & (any_session | F.array_contains(named, F.col("session")))


def _right_regime() -> Column:
    wanted = F.coalesce(F.col("regime_target"), F.lit(""))
    return (wanted == "") | F.coalesce(F.upper("regime") == F.upper(wanted), F.lit(False))


#: code, rule, columns that explain the outcome; the order is the order of evaluation
CHECKS: list[tuple[str, Callable[[], Column], tuple[str, ...]]] = [
    ("connection", lambda: F.col("connected"), ()),
    ("strategy", lambda: F.col("strategy_id").isNotNull(), ("strategy_id",)),
    ("freshness", lambda: F.col("data_fresh"), ("stale_seconds",)),
    ("spread", lambda: F.col("spread_pips") <= F.col("max_spread_pips"), ("spread_pips", "max_spread_pips")),
    ("session", _free_session, ("session",)),
    ("regime", _right_regime, ("regime", "regime_target")),
    ("risk", lambda: ~F.col("safe_mode") & F.col("daily_loss_ok") & F.col("drawdown_ok"), ("safe_mode", "daily_loss_ok", "drawdown_ok")),
    ("margin", lambda: F.col("free_margin") >= F.col("required_margin"), ("free_margin", "required_margin")),
    ("positions", lambda: (F.col("open_positions") < F.col("max_open_positions")) & ~F.col("conflicting"), ("open_positions", "max_open_positions", "conflicting")),
]


def checklist(df: DataFrame) -> DataFrame:
    """The pre-trade checks as an array of (item_id, name, pass, detail), with all_passed, failed_items and first_failure_reason.

    ``detail`` lists the values a check looked at as name=value; a failure reason is the check's code and its detail.
    Expects the columns named in ``CHECKS`` and allowed_sessions.
    """
    def item(number: int, code: str, rule: Callable[[], Column], shown: tuple[str, ...]) -> Column:
        detail = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in shown])
        return F.struct(F.lit(number).alias("item_id"), F.lit(code).alias("name"), rule().alias("pass"), detail.alias("detail"))

    out = df.withColumn("checklist", F.array(*[item(i, *check) for i, check in enumerate(CHECKS, 1)]))
    failed = F.filter("checklist", lambda x: ~x["pass"])
    first = F.get(failed, F.lit(0))
    return out.withColumns({"all_passed": F.size(failed) == 0, "failed_items": F.size(failed),
                            "first_failure_reason": F.rtrim(F.concat(first["name"], F.lit(" "), first["detail"]))})


def mandate_gate(df: DataFrame, mandate: dict | None) -> DataFrame:
    """Add ``allowed``, ``gate_reason`` (code and values of the first rule of the mandate that forbids the trade, else ``pass``) and
    ``violations``, the codes of all rules that do. Needs symbol, safe_mode, risk_per_trade_pct, breaker_tripped, daily_halt."""
    if mandate is None:
        rules = [("without_mandate", F.lit(True), {})]
    else:
        traded, limit = F.upper("symbol"), F.lit(float(mandate["max_daily_risk_pct"]))
        rules = [("safe_mode", F.col("safe_mode"), {}), ("symbol_not_traded", ~traded.isin(list(mandate["symbol_universe"])), {"symbol": traded}),
                 ("risk_too_high", F.col("risk_per_trade_pct") > limit, {"risk": F.col("risk_per_trade_pct"), "limit": limit}),
                 ("breaker_open", F.col("breaker_tripped"), {}), ("day_halted", F.col("daily_halt"), {})]
    hits = F.array_compact(F.array(*[F.when(holds, F.lit(code)) for code, holds, _ in rules]))
    return df.withColumns({"violations": hits, "gate_reason": F.coalesce(_first_code(rules), F.lit("pass")), "allowed": F.size(hits) == 0})
