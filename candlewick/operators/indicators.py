"""Indicators over ordered bars; NULL until enough history exists.

Inputs carry ``row_no`` (see ``ordered.index_rows``). Each operator works on chunks of bars with the
halo it needs for bounded windows; EMA and Wilder averages are affine maps composed along the chunks. Where many averages share
one shuffle (``features``, ``long_indicators``) their halo holds all rows they can remember.
A missing input (NULL or NaN) leaves an average as it is, here as there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.functions.calendar import session_label

KEYS = ["symbol"]


class IndicatorError(ValueError):
    """A period or width that makes no sense."""


def _need(period: int, least: int, what: str) -> None:
    if period < least:
        raise IndicatorError(f"{what} period must be >= {least}, got {period}")


# ---- columns for rows that are already chunked -------------------------------------------------

def sma_col(src: str, n: int, keys: Sequence[str] = KEYS, first_row: int = 1) -> Column:
    """Mean of the last ``n`` values; ``first_row`` is where ``src`` starts."""
    w = ordered.chunk_window(keys).rowsBetween(-(n - 1), 0)
    return F.when(F.col("row_no") >= first_row + n - 1, F.avg(src).over(w))


def prev_col(src: str, keys: Sequence[str] = KEYS, by: int = 1) -> Column:
    return F.lag(src, by).over(ordered.chunk_window(keys))


def seeded_average(src: str, n: int, alpha: float, first_row: int, halo: int, size: int,
                   keys: Sequence[str] = KEYS) -> Column:
    """Recurrence seeded with the plain mean of the first ``n`` values."""
    w = ordered.chunk_window(keys).rowsBetween(-(n - 1), 0)
    return ordered.recurrence(F.col(src), F.avg(ordered.known(F.col(src))).over(w), first_row + n - 1, alpha, keys, halo, size)


def ema_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def wilder_alpha(n: int) -> float:
    return 1.0 / n


# ---- one indicator at a time ------------------------------------------------------------------

def _chunked(indexed: DataFrame, lookback: int, chains: Sequence[Sequence[float]] = ()) -> tuple[DataFrame, int, int]:
    return ordered.chunked(indexed, lookback, chains)


def sma(indexed: DataFrame, period: int, src: str = "close", out: str = "sma") -> DataFrame:
    _need(period, 1, "SMA")
    rows, _, _ = _chunked(indexed, period)
    return ordered.own_rows(rows.withColumn(out, sma_col(src, period)))


def volume_sma(indexed: DataFrame, period: int = 20, out: str = "volume_sma") -> DataFrame:
    _need(period, 1, "Volume SMA")
    return sma(indexed, period, "volume", out)


def _average(rows: DataFrame, specs: dict[str, tuple[str, int, float, int]]) -> DataFrame:
    return ordered.averages(ordered.plain(rows), KEYS, specs)


def ema(indexed: DataFrame, period: int, src: str = "close", out: str = "ema") -> DataFrame:
    _need(period, 1, "EMA")
    return _average(indexed, {out: (src, period, ema_alpha(period), 1)})


def macd(indexed: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Line, signal and histogram, for any periods: both averages in one scan, the signal in a second."""
    lo, hi = sorted((fast, slow))
    rows = _average(indexed, {"_f": ("close", lo, ema_alpha(lo), 1), "_s": ("close", hi, ema_alpha(hi), 1)}).withColumn("macd", F.col("_f") - F.col("_s"))
    rows = _average(rows, {"macd_signal": ("macd", signal, ema_alpha(signal), hi)})
    return rows.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def _with_previous(indexed: DataFrame, *cols: str) -> DataFrame:
    """Add the previous bar's values as ``_p`` and their first letter."""
    rows, _, _ = _chunked(indexed, 1)
    return ordered.own_rows(rows.withColumns({f"_p{c[0]}": prev_col(c) for c in cols}))


def _step_cols() -> dict[str, Column]:
    """Gains and losses; needs the previous close ``_pc``."""
    move = F.col("close") - F.col("_pc")
    known = F.col("_pc").isNotNull()
    return {"_gain": F.when(known, F.greatest(move, F.lit(0.0))), "_loss": F.when(known, F.greatest(-move, F.lit(0.0)))}


def _rsi_from(gain: str, loss: str) -> Column:
    return F.try_divide(F.col(gain) * 100, F.col(gain) + F.col(loss))


def rsi(indexed: DataFrame, period: int = 14, out: str = "rsi") -> DataFrame:
    _need(period, 2, "RSI")
    rows = _with_previous(indexed, "close").withColumns(_step_cols())
    rows = _average(rows, {f"_a{c}": (f"_{word}", period, wilder_alpha(period), 2) for c, word in (("g", "gain"), ("l", "loss"))})
    return rows.withColumn(out, _rsi_from("_ag", "_al")).drop("_pc", "_gain", "_loss", "_ag", "_al")


def _range_cols() -> dict[str, Column]:
    """True range; needs ``_pc``."""
    return {"_tr": F.when(F.col("_pc").isNotNull(), F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))))}


def atr(indexed: DataFrame, period: int = 14, out: str = "atr") -> DataFrame:
    _need(period, 1, "ATR")
    rows = _with_previous(indexed, "close").withColumns(_range_cols())
    return _average(rows, {out: ("_tr", period, wilder_alpha(period), 2)}).drop("_pc", "_tr")


def bollinger(indexed: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """Bands from the population deviation."""
    _need(period, 2, "BB")
    if width <= 0:
        raise IndicatorError(f"BB std must be > 0, got {width}")
    rows, _, _ = _chunked(indexed, period)
    return ordered.own_rows(rows.withColumns(_bollinger_base(period)).withColumns(_bollinger_bands(width))).drop("_sd")


def _bollinger_base(period: int) -> dict[str, Column]:
    w = ordered.chunk_window(KEYS).rowsBetween(-(period - 1), 0)
    full = F.col("row_no") >= period
    return {"bb_mid": F.when(full, F.avg("close").over(w)), "_sd": F.when(full, F.stddev_pop("close").over(w))}


def _bollinger_bands(width: float) -> dict[str, Column]:
    mid, off = F.col("bb_mid"), F.col("_sd") * width
    return {"bb_upper": mid + off, "bb_lower": mid - off, "bb_width": F.try_divide(off * 2 * 100, mid),
            "bb_pct": F.try_divide(F.col("close") - (mid - off), off * 2)}


def donchian_cols(period: int, upper: str, lower: str) -> dict[str, Column]:
    """Channel of the ``period`` bars before the current one."""
    w = ordered.chunk_window(KEYS).rowsBetween(-period, -1)
    full = F.col("row_no") > period
    return {upper: F.when(full, F.max("high").over(w)), lower: F.when(full, F.min("low").over(w))}


def donchian(indexed: DataFrame, period: int = 20) -> DataFrame:
    _need(period, 1, "Donchian")
    rows, _, _ = _chunked(indexed, period)
    rows = rows.withColumns(donchian_cols(period, "upper", "lower"))
    return ordered.own_rows(rows.withColumn("mid", (F.col("upper") + F.col("lower")) / 2))


def _directional_cols() -> dict[str, Column]:
    """Directional moves; needs the previous high and low ``_ph``, ``_pl``."""
    up, down = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    known = F.col("_ph").isNotNull()
    return {"_up": F.when(known, F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0))),
            "_dn": F.when(known, F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)))}


def _di_cols(smoothed_range: str) -> dict[str, Column]:
    r = F.col(smoothed_range)
    di = lambda c: F.when(r.isNotNull(), F.coalesce(F.try_divide(F.col(c) * 100, r), F.lit(0.0)))
    return {"dmp": di("_au"), "dmn": di("_ad")}


def _dx_col() -> Column:
    total = F.col("dmp") + F.col("dmn")
    return F.when(total.isNotNull(), F.coalesce(F.try_divide(F.abs(F.col("dmp") - F.col("dmn")) * 100, total), F.lit(0.0)))


def adx(indexed: DataFrame, period: int = 14) -> DataFrame:
    _need(period, 2, "ADX")
    a = wilder_alpha(period)
    rows = _with_previous(indexed, "close", "high", "low").withColumns({**_range_cols(), **_directional_cols()})
    rows = _average(rows, {f"_a{c[1]}": (c, period, a, 2) for c in ("_up", "_dn")} | {"_ar": ("_tr", period, a, 2)})
    rows = rows.withColumns(_di_cols("_ar")).withColumn("_dx", _dx_col())
    rows = _average(rows, {"adx": ("_dx", period, a, period + 1)})
    return rows.drop("_pc", "_tr", "_ph", "_pl", "_up", "_dn", "_ar", "_au", "_ad", "_dx")


def regime_label(adx_: Column, ratio: Column) -> Column:
    """NULL in warm-up; quiet and volatile outrank trend strength."""
    return (F.when(adx_.isNull() | ratio.isNull(), F.lit(None).cast("string"))
            .when(ratio < 0.7, "QUIET").when(ratio > 1.5, "VOLATILE").when(adx_ > 25, "TRENDING")
            .when(adx_ < 20, "RANGING").otherwise("TRANSITIONING"))


def crossed_above(fast: Column, fast_prev: Column, slow: Column, slow_prev: Column) -> Column:
    return (fast_prev <= slow_prev) & (fast > slow)


def crossed_below(fast: Column, fast_prev: Column, slow: Column, slow_prev: Column) -> Column:
    return (fast_prev >= slow_prev) & (fast < slow)


# ---- everything a strategy needs --------------------------------------------------------------

DEFAULTS = {"fast_ma_period": 10, "slow_ma_period": 50, "ma_type": "SMA", "rsi_period": 14}


def features(indexed: DataFrame, params: dict | None = None) -> DataFrame:
    """All indicators of one parameter set with the previous bar's values, from one shuffle.

    Simple windows, RSI, ATR and ADX share their chunks. EMA averages decay at other rates and take
    chunks of their own first.
    """
    p = {**DEFAULTS, **(params or {})}
    fast, slow, n = p["fast_ma_period"], p["slow_ma_period"], int(p["rsi_period"])
    use_ema = p["ma_type"] == "EMA"
    if use_ema:
        indexed = ema(ema(indexed, fast, out="sma_fast"), slow, out="sma_slow")
    w14, wr = wilder_alpha(14), wilder_alpha(n)
    longest = max(fast, slow, p.get("channel_period", 0), p.get("exit_period", 0), 20, n + 1)
    # one extra row for lagged values, 20 for the ATR average and 28 for the two stacked seeds
    rsi_apart = not ordered.fits([[w14, w14], [wr]], longest + 50)
    if rsi_apart:
        indexed = rsi(indexed, n)
    rows, halo, size = _chunked(indexed, longest + 50, [[w14, w14]] if rsi_apart else [[w14, w14], [wr]])
    prev = lambda c: prev_col(c)
    base = {"_pc": prev("close"), "_ph": prev("high"), "_pl": prev("low"), "volume_sma": sma_col("volume", 20),
            **_bollinger_base(20)}
    if not use_ema:
        base |= {"sma_fast": sma_col("close", fast), "sma_slow": sma_col("close", slow)}
    if "channel_period" in p:
        base |= donchian_cols(p["channel_period"], "donchian_upper_entry", "donchian_lower_entry")
        base |= donchian_cols(p["exit_period"], "donchian_upper_exit", "donchian_lower_exit")
    average = lambda src, k, a: seeded_average(src, k, a, 2, halo, size)
    steps = [
        base,
        {**_step_cols(), **_range_cols(), **_directional_cols(), **_bollinger_bands(2.0),
         "volume_rel": F.try_divide("volume", "volume_sma"), "session": session_label(F.col("ts"))},
        {**({} if rsi_apart else {"_ag": average("_gain", n, wr), "_al": average("_loss", n, wr)}), "atr": average("_tr", 14, w14),
         "_au": average("_up", 14, w14), "_ad": average("_dn", 14, w14)},
        {**({} if rsi_apart else {"rsi": _rsi_from("_ag", "_al")}), **_di_cols("atr"), "atr_sma20": sma_col("atr", 20, first_row=15)},
        {"_dx": _dx_col(), "atr_ratio": F.try_divide("atr", "atr_sma20"),
         **{f"{c}_prev": prev(c) for c in ("sma_fast", "sma_slow", "rsi")}},
        {"adx": seeded_average("_dx", 14, w14, 15, halo, size)},
        {"regime": regime_label(F.col("adx"), F.col("atr_ratio"))},
    ]
    for cols in steps:
        rows = rows.withColumns(cols)
    return rows.filter("_own").drop("_chunk", "_own", *[c for c in rows.columns if c.startswith("_")])


# What a strategy sees while an indicator is still warming up.
WARMUP_DEFAULTS = {"rsi": 50.0, "rsi_prev": 50.0, "bb_pct": 0.5, "atr": 0.0, "adx": 0.0, "atr_ratio": 1.0,
                   "volume_rel": 1.0}


def finite_or(c: Column, default: float) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(c)


def with_warmup_defaults(feats: DataFrame) -> DataFrame:
    """Replace missing and non-finite values the way strategies expect them; averages stay NULL."""
    return feats.withColumns({c: finite_or(F.col(c), v) for c, v in WARMUP_DEFAULTS.items() if c in feats.columns})


def ma_distance_ticks(price: Column, ma: Column, tick_size: Column) -> Column:
    return F.when(ma.isNotNull() & (tick_size > 0), F.round(F.try_divide(F.abs(price - ma), tick_size), 2)).otherwise(F.lit(0.0))


def long_indicators(indexed: DataFrame, sma_periods: Sequence[int] = (), ema_periods: Sequence[int] = (),
                    channel_periods: Sequence[int] = ()) -> DataFrame:
    """symbol, row_no, ts, kind, period, value, value_prev, upper, lower for many periods at once.

    Every period carries its own chunk layout, so one shuffle serves all of them and parameter sets
    that share a period share its rows.
    """
    plan = []
    for kind, periods in (("SMA", sma_periods), ("EMA", ema_periods), ("CHANNEL", channel_periods)):
        for n in sorted(set(periods)):
            _need(n, 1, kind)
            alpha = ema_alpha(n) if kind == "EMA" else 1.0
            halo, size = ordered.chunk_plan([[alpha]] if kind == "EMA" else [], n + 1)
            plan.append(F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("period"), F.lit(alpha).alias("_alpha"),
                                 F.lit(halo).alias("_halo"), F.lit(size).alias("_size")))
    at = F.col("row_no") - 1
    rows = (indexed.select("symbol", "row_no", "ts", "high", "low", "close")
            .withColumn("_p", F.explode(F.array(*plan)))
            .select("symbol", "row_no", "ts", "high", "low", "close", "_p.*")
            .withColumn("_first", F.floor(at / F.col("_size")))
            .withColumn("_chunk", F.explode(F.sequence(F.col("_first"), F.floor((at + F.col("_halo")) / F.col("_size")))))
            .withColumn("_own", F.col("_chunk") == F.col("_first")).drop("_first"))
    keys = ["symbol", "kind", "period"]
    w = ordered.chunk_window(keys)
    upto = w.rowsBetween(-(1 << 30), 0)
    x = ordered.known(F.col("close"))
    frames = []
    for kind, periods in (("SMA", sma_periods), ("CHANNEL", channel_periods)):
        frames += [(kind, n) for n in sorted(set(periods))]
    sma_value, upper, lower = (F.lit(None).cast("double") for _ in range(3))
    for kind, n in frames:
        this = (F.col("kind") == kind) & (F.col("period") == n)
        if kind == "SMA":
            sma_value = F.when(this & (F.col("row_no") >= n), F.avg("close").over(w.rowsBetween(-(n - 1), 0))).otherwise(sma_value)
        else:
            back = w.rowsBetween(-n, -1)
            upper = F.when(this & (F.col("row_no") > n), F.max("high").over(back)).otherwise(upper)
            lower = F.when(this & (F.col("row_no") > n), F.min("low").over(back)).otherwise(lower)
    seed = F.lit(None).cast("double")
    for n in sorted(set(ema_periods)):
        seed = F.when((F.col("kind") == "EMA") & (F.col("period") == n),
                      F.avg(x).over(w.rowsBetween(-(n - 1), 0))).otherwise(seed)
    rows = rows.withColumn("_lost", F.count_if(x.isNull()).over(upto))
    pos = F.col("row_no") - (F.col("_chunk") * F.col("_size") + 1 - F.col("_halo")) - F.col("_lost")
    keep = F.lit(1.0) - F.col("_alpha")
    scaled = (F.when(F.col("kind") != "EMA", F.lit(0.0)).when(F.col("row_no") == F.col("period"), F.col("_seed"))
              .when((F.col("row_no") > F.col("period")) & x.isNotNull(), F.col("_alpha") * x).otherwise(F.lit(0.0)))
    ema_value = F.when((F.col("kind") == "EMA") & (F.col("row_no") >= F.col("period")),
                       F.when(F.col("period") == 1, F.last(x, ignorenulls=True).over(upto)).otherwise(F.col("_run") * F.pow(keep, pos)))
    weight = F.when((F.col("kind") == "EMA") & (F.col("period") > 1), F.pow(keep, -pos)).otherwise(F.lit(0.0))
    out = (rows.withColumn("_sma", sma_value).withColumn("upper", upper).withColumn("lower", lower)
           .withColumn("_seed", seed).withColumn("_run", F.sum(scaled * weight).over(upto))
           .withColumn("value", F.coalesce("_sma", ema_value, (F.col("upper") + F.col("lower")) / 2))
           .withColumn("value_prev", F.lag("value").over(w)))
    return out.filter("_own").select("symbol", "row_no", "ts", "kind", "period", "value", "value_prev", "upper", "lower")


def change_audit(before: DataFrame, after: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Look-ahead audit of two computations that must agree: rows compared and rows changed, per ``by``."""
    both = before.withColumn("_s", F.lit(1)).unionByName(after.withColumn("_s", F.lit(-1)))
    rows = both.groupBy(*before.columns).agg(F.count_if(F.col("_s") == 1).alias("_n"), F.sum("_s").alias("_d"))
    return rows.groupBy(*by).agg(F.sum("_n").alias("compared"), F.sum(F.greatest(F.col("_d"), F.lit(0))).alias("changed"))


def dominant_regime(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent regime per key; ties go to the lowest label. Counts first, so no hot group."""
    counts = labelled.filter(F.col("regime").isNotNull()).groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("regime").alias("r"))).alias("_b"))
    return top.select(*keys, F.col("_b.r").alias("dominant_regime"))
