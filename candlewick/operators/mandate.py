"""Risk-limit evaluation of equity curves and trades."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from candlewick.functions import hashing, money, ordered
from candlewick.functions.calendar import mandate_date
from candlewick.functions.staging import stage
from candlewick.operators.paths import equity_path

# Default circuit breakers of the live side, in percent.
MAX_DAILY_LOSS_PCT = 3.0
MAX_TRAILING_DD_PCT = 6.0


def trading_days(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct mandate dates of entries; dates are reduced per key before they are counted."""
    days = trades.select(*keys, mandate_date(F.col("entry_time")).alias("_day")).distinct()
    return days.groupBy(*keys).agg(F.count(F.lit(1)).alias("trading_days"))


def opens_day(keys: Sequence[str]) -> Column:
    """True on one row of each key and mandate date of entry: ``trading_days`` is their number. Rows dealt by key stay where they are."""
    day = mandate_date(F.col("entry_time"))
    return F.row_number().over(Window.partitionBy(*keys, day).orderBy(day)) == 1


def with_daily_start(path: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None) -> DataFrame:
    """Equity at the day's reset. A reset happens at rows whose date exceeds every earlier date, which
    also holds for rows in shuffled date order. Needs ``day`` and ``_max_day`` (exclusive running max).
    In chunks the path itself is two passes over its input, so it is written once before being read twice; whole keys are read once.
    """
    path = path if chunk is None else stage(path)
    reset = F.col("_max_day").isNull() | (F.col("day") > F.col("_max_day"))
    return ordered.running(path, keys, order, chunk, {"daily_start": ("last", F.when(reset, F.col("equity")))}).drop("_max_day")


def limits(path: DataFrame, initial_equity: float, mandate: dict) -> DataFrame:
    """Daily loss and drawdown per point (needs equity, peak_equity, daily_start) and breach rule.

    The daily rule is tested before the drawdown rule; both breach at equality.
    """
    start = F.lit(float(initial_equity))
    static = str(mandate["drawdown_type"]).lower() == "static"
    ref = start if static else F.col("peak_equity")
    daily = F.when(F.col("daily_start") > 0, F.try_divide((F.col("daily_start") - F.col("equity")) * 100, F.col("daily_start"))).otherwise(0.0)
    dd = F.when(ref > 0, F.try_divide((ref - F.col("equity")) * 100, ref)).otherwise(0.0)
    return (path.withColumn("daily_loss_pct", daily).withColumn("overall_dd_pct", dd)
            .withColumn("breach", F.when(F.col("daily_loss_pct") >= mandate["max_daily_loss_pct"], "MANDATE_DAILY_LOSS_BREACH")
                        .when(F.col("overall_dd_pct") >= mandate["max_overall_drawdown_pct"], "MANDATE_OVERALL_DD_BREACH")))


def curve_points(curve: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None, initial_equity: float,
                 mandate: dict, strict: bool = False) -> DataFrame:
    """Limits along a given curve (keys, order columns, ts, equity). ``strict`` fails on bad points."""
    eq = F.col("equity")
    if strict:
        bad = violation(eq, F.col("ts"))
        eq = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("bad equity point: "), bad)).cast("double")).otherwise(eq)
    dated = curve.withColumn("equity", eq).withColumn("day", mandate_date(F.col("ts")))
    path = ordered.running(dated, keys, order, chunk, {
        "_max_day": ("max", F.col("day"), True), "peak_equity": ("max", F.col("equity"))})
    path = path.withColumn("peak_equity", F.greatest(F.lit(float(initial_equity)), F.col("peak_equity")))
    return limits(with_daily_start(path, keys, order, chunk), initial_equity, mandate)


def trade_points(trades: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None, initial_equity: float,
                 mandate: dict, pnl: Column | None = None) -> DataFrame:
    """Limits after every closed trade."""
    dated = trades.withColumn("day", mandate_date(F.col("exit_time")))
    path = equity_path(dated, keys, order, chunk, initial_equity, pnl, extra={"_max_day": ("max", F.col("day"), True)})
    return limits(with_daily_start(path, keys, order, chunk), initial_equity, mandate)


def first_breach(points: DataFrame, keys: Sequence[str], order: Sequence[str], mandate: dict) -> DataFrame:
    """One row per key: compliant or the first breach with its values."""
    at = F.when(F.col("breach").isNotNull(), F.struct(*[F.col(c) for c in order]))
    hit = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(F.struct("breach", "day", "daily_loss_pct", "overall_dd_pct"), at).alias("_b"))
    daily = F.col("_b.breach") == "MANDATE_DAILY_LOSS_BREACH"
    value = F.when(daily, F.col("_b.daily_loss_pct")).otherwise(F.col("_b.overall_dd_pct"))
    limit = F.when(daily, F.lit(mandate["max_daily_loss_pct"])).otherwise(F.lit(mandate["max_overall_drawdown_pct"]))
    return hit.select(*keys, "points", F.col("_b.breach").isNull().alias("compliant"), F.col("_b.breach").alias("breach"),
                      F.when(F.col("_b.breach").isNotNull(), value).alias("breach_pct"),
                      F.when(F.col("_b.breach").isNotNull(), F.col("_b.day")).alias("breach_day"),
                      F.when(F.col("_b.breach").isNotNull(), F.format_string(
                          "%s: reached %.2f%% (limit: %.2f%%)", F.col("_b.breach"), value, limit)).alias("breach_reason"))


def risk_cap(trades: DataFrame, keys: Sequence[str], order: Sequence[str], mandate: dict,
             configured_risk_pct: float | None = None) -> DataFrame:
    """First trade whose ``risk_pct`` is over the cap; a configured risk over the cap comes first."""
    cap = mandate["max_daily_risk_pct"]
    over = F.col("risk_pct") > cap
    first = F.struct(*order)
    out = trades.groupBy(*keys).agg(
        F.min_by("risk_pct", F.when(over, first)).alias("first_risk_pct"), F.count_if(over).alias("offenders"))
    configured = F.lit(configured_risk_pct is not None and configured_risk_pct > cap)
    return out.withColumn("breach", F.when(configured, "CONFIGURED_RISK").when(F.col("offenders") > 0, "TRADE_RISK"))


def min_trading_days(trades: DataFrame, keys: Sequence[str], mandate: dict) -> DataFrame:
    return trading_days(trades, keys).withColumn("enough_days", F.col("trading_days") >= mandate["min_trading_days"])


def violation(equity: Column, ts: Column) -> Column:
    """Why a curve point cannot be evaluated; NULL for good points."""
    return (F.when(equity.isNull(), "MISSING_EQUITY").when(F.isnan(equity) | (F.abs(equity) == float("inf")), "NON_FINITE_EQUITY")
            .when(ts.isNull(), "MISSING_TIMESTAMP"))


def curve_violations(curve: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Counts of unusable points and whether the curve starts above zero."""
    v = violation(F.col("equity"), F.col("ts"))
    return curve.groupBy(*keys).agg(
        F.count_if(v == "MISSING_EQUITY").alias("missing_equity"), F.count_if(v == "NON_FINITE_EQUITY").alias("non_finite"),
        F.count_if(v == "MISSING_TIMESTAMP").alias("missing_ts"),
        (F.min_by("equity", F.struct(*order)) > 0).alias("positive_start"))


def breaker_status(curve: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None, initial_equity: float,
                   mandate: dict, max_daily_loss_pct: float = MAX_DAILY_LOSS_PCT,
                   max_dd_pct: float = MAX_TRAILING_DD_PCT) -> DataFrame:
    """Sticky circuit breaker along a live equity curve, UTC and mandate days both watched."""
    points = curve_points(curve, keys, order, chunk, initial_equity, mandate)
    once = stage if chunk is not None else lambda df: df  # only chunks read their input twice
    utc = once(points).withColumn("_utc", F.to_date("ts"))
    utc = ordered.running(utc, keys, order, chunk, {"_max_utc": ("max", F.col("_utc"), True)})
    reset = F.col("_max_utc").isNull() | (F.col("_utc") > F.col("_max_utc"))
    utc = ordered.running(once(utc), keys, order, chunk, {"utc_start": ("last", F.when(reset, F.col("equity")))})
    daily = F.when(F.col("utc_start") > 0, F.try_divide((F.col("equity") - F.col("utc_start")) * 100, F.col("utc_start"))).otherwise(0.0)
    hit = ((daily <= -max_daily_loss_pct) | (F.col("overall_dd_pct") >= max_dd_pct) | F.col("breach").isNotNull())
    out = ordered.running(once(utc).withColumn("daily_pnl_pct", daily).withColumn("trips", hit.cast("int")), keys, order, chunk,
                          {"_tripped": ("max", F.col("trips"))})
    return out.withColumn("tripped", F.col("_tripped") == 1).drop("_tripped", "_utc", "_max_utc")


def _reshuffled(trades: DataFrame, keys: Sequence[str], trade_key: Sequence[str], pip_value: Column, max_slippage_pips: float) -> DataFrame:
    """Each row's place in the order of its ``perm`` and its P&L after that permutation's slippage (needs _ident, perm, day)."""
    slip = money.uniform_hash(F.lit("slip"), F.col("perm"), F.col("_ident")) * max_slippage_pips * pip_value * F.col("lots")
    return (trades.withColumn("_place", money.uniform_hash(F.lit("order"), F.col("perm"), F.col("_ident")))
            .withColumn("_pnl", F.col("net_pnl") - slip)
            .select(*dict.fromkeys([*keys, *trade_key, "perm", "_place", "_pnl", "day", "exit_time"])))


def _failing(rows: DataFrame, per: Sequence[str], order: Sequence[str], chunk: Column, initial_equity: float, mandate: dict) -> DataFrame:
    """Whether each path breaches at all: (per, failed), without a row per point behind the one shuffle.

    Between two resets of the day's start equity both limits depend on the lowest equity only. A chunk's candidate resets
    are the rows with a later day than all before them in the chunk, about ln(rows) many in a shuffled order, so
    every chunk shrinks to that many stretches. Which of them are resets, and the equity they start from, follows from
    the stretches before them. A trailing limit also needs the lowest equity against the peak inside the chunk.
    """
    keep = 1 - mandate["max_overall_drawdown_pct"] / 100.0
    w = Window.partitionBy(*per, "_chunk").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = (rows.withColumn("_chunk", chunk).withColumn("_pnl", F.coalesce("_pnl", F.lit(0.0)))
             .withColumn("_sum", F.sum("_pnl").over(upto)).withColumn("_latest", F.max("day").over(before)))
    opens = F.col("_latest").isNull() | F.coalesce(F.col("day") > F.col("_latest"), F.lit(False))
    local = local.withColumn("_opens", opens).withColumn("_peak", F.max("_sum").over(upto)).withColumn("_stretch", F.count_if("_opens").over(upto))
    stretches = local.groupBy(*per, "_chunk", "_stretch").agg(
        F.sum("_pnl").alias("_step"), F.max(F.when(F.col("_opens"), F.col("_pnl"))).alias("_first"), F.max(F.when(F.col("_opens"), F.col("_sum"))).alias("_at"),
        F.min("_sum").alias("_low"), F.max("_sum").alias("_high"), F.min(F.col("_sum") - keep * F.col("_peak")).alias("_fall"), F.max("day").alias("day"))
    along = Window.partitionBy(*per).orderBy("_chunk", "_stretch")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(float(initial_equity))
    based = (stretches.withColumn("_base", start + F.coalesce(F.sum("_step").over(earlier), F.lit(0.0)) + F.col("_first") - F.col("_at"))  # equity where _sum is 0
             .withColumn("_latest", F.max("day").over(earlier)).withColumn("equity", F.col("_base") + F.col("_low")))
    reset = F.col("_latest").isNull() | (F.col("day") > F.col("_latest"))
    based = (based.withColumn("daily_start", F.last(F.when(reset, F.col("_base") + F.col("_at")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("peak_equity", F.greatest(start, F.max(F.col("_base") + F.col("_high")).over(earlier))))
    hit = F.col("breach").isNotNull()
    if str(mandate["drawdown_type"]).lower() != "static":
        hit = hit | ((1 - keep) * F.col("_base") + F.col("_fall") <= 0)
    return limits(based, initial_equity, mandate).groupBy(*per).agg(F.bool_or(hit).alias("failed"))


# permuted trades that one task of ``_stress_whole`` looks at, about
TASK_PERMUTED = 16_000_000
NO_DAY = -(1 << 31)


def _resets(days: np.ndarray) -> np.ndarray:
    """Places along the second axis whose day exceeds all before; a day of NO_DAY exceeds none, but resets until the first day."""
    upto = np.maximum.accumulate(days, axis=1)
    out = np.ones(days.shape, dtype=bool)
    out[:, 1:] = (upto[:, :-1] == NO_DAY) | (days[:, 1:] > upto[:, :-1])
    return out


def _breaches(pnl: np.ndarray, resets: np.ndarray, initial_equity: float, mandate: dict, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Per point of the paths (path, place): daily rule broken, drawdown rule broken. ``slack`` shifts both limits up."""
    equity = initial_equity + np.cumsum(pnl, axis=1)
    place = np.arange(pnl.shape[1])
    start = np.take_along_axis(equity, np.maximum.accumulate(np.where(resets, place, 0), axis=1), axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        daily = np.where(start > 0, (start - equity) * 100 / start, 0.0) >= mandate["max_daily_loss_pct"] + slack
        if str(mandate["drawdown_type"]).lower() == "static":
            dd = (initial_equity - equity) * 100 / initial_equity if initial_equity > 0 else np.zeros_like(equity)
        else:
            peak = np.maximum(initial_equity, np.maximum.accumulate(equity, axis=1))
            dd = np.where(peak > 0, (peak - equity) * 100 / peak, 0.0)
    return daily, dd >= mandate["max_overall_drawdown_pct"] + slack


def _hits(pnl: np.ndarray, resets: np.ndarray, initial_equity: float, mandate: dict, slack: float = 0.0) -> np.ndarray:
    """Per path (path, place): whether ``_breaches`` finds any point. Both limits of a static mandate grow as equity falls, so one look at
    the lowest equity of each stretch between resets is enough."""
    if str(mandate["drawdown_type"]).lower() != "static" or initial_equity <= 0:
        return np.logical_or(*_breaches(pnl, resets, initial_equity, mandate, slack)).any(axis=1)
    if not len(pnl):
        return np.zeros(0, dtype=bool)
    total, at = np.cumsum(pnl, axis=1).ravel(), np.flatnonzero(resets)
    start, low = initial_equity + total[at], initial_equity + np.fmin.reduceat(total, at)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(start > 0, (start - low) * 100 / start, 0.0) >= mandate["max_daily_loss_pct"] + slack
    hit |= (initial_equity - low) * 100 / initial_equity >= mandate["max_overall_drawdown_pct"] + slack
    return np.bincount(at[hit] // pnl.shape[1], minlength=len(pnl)) > 0


def _stress_one(ident: list[bytes], pnl: np.ndarray, pip: np.ndarray, lots: np.ndarray, days: np.ndarray, permutations: int, max_slippage_pips: float,
                initial_equity: float, mandate: dict) -> tuple[int, str | None]:
    """(failing permutations, rule that the first of them breaks) of one key whose trades come in the order of their key; NaN is a missing value.

    Slippage only ever lowers equity, and by a known highest amount per trade. So a path that breaks a rule without slippage fails, one that
    keeps both under the highest slippage passes, and slippage is worked out only for the paths between, up to the last point where the highest
    one breaks a rule.
    """
    known = ~(np.isnan(pnl) | np.isnan(pip) | np.isnan(lots))
    pnl, pip, lots = (np.where(known, x, 0.0) for x in (pnl, pip, lots))
    most, seat, margin = max_slippage_pips * pip * lots, np.arange(len(pnl), dtype=np.uint64), 1e-6
    worst = pnl - most
    # a limit of 100 % or less breaks before equity is used up, below which a daily loss is not defined
    bounded = bool(np.all(most >= 0)) and initial_equity > 0 and mandate["max_overall_drawdown_pct"] <= 100
    places, slips = hashing.UniformHeads("order", ident), hashing.UniformHeads("slip", ident)
    failed: list[int] = []
    between: list[tuple[int, np.ndarray]] = []

    def sequence(heads: np.ndarray) -> np.ndarray:
        """Trades by hash; equal hashes stay in the order of the trade key."""
        key = heads.astype(np.uint64)
        key <<= np.uint64(32)
        key |= seat
        key.sort(axis=1)
        key &= np.uint64(0xFFFFFFFF)
        return key.view(np.int64)

    def exact(paths: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """P&L after slippage and resets along paths (permutation, trades), behind whose ends nothing changes."""
        sizes = np.array([len(o) for _, o in paths])
        which, trade = np.repeat(np.arange(len(paths)), sizes), np.concatenate([o for _, o in paths])
        place = np.arange(len(trade)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        net, day = np.zeros((len(paths), sizes.max())), np.full((len(paths), sizes.max()), NO_DAY)
        slip = slips.pairs([p for p, _ in paths], which, trade) / 4294967296.0 * max_slippage_pips * pip[trade] * lots[trade]
        net[which, place], day[which, place] = pnl[trade] - slip, days[trade]
        return net, _resets(day)

    def settle() -> None:
        between.sort(key=lambda x: len(x[1]))
        while between:  # paths of about one length, the longest first
            at = max(0, len(between) - max(1, hashing.BLOCK_ROWS // len(between[-1][1])))
            failed.extend(p for (p, _), hit in zip(between[at:], _hits(*exact(between[at:]), initial_equity, mandate)) if hit)
            del between[at:]

    for first, heads in places.parts(range(permutations)):
        orders, numbers = sequence(heads), np.arange(first, first + len(heads))
        ends = np.full(len(orders), len(pnl))
        if bounded:
            resets = _resets(days[orders])
            sure = _hits(pnl[orders], resets, initial_equity, mandate, margin)
            failed.extend(numbers[sure].tolist())
            orders, resets, numbers = orders[~sure], resets[~sure], numbers[~sure]
            low = worst[orders]
            risky = _hits(low, resets, initial_equity, mandate, -margin)
            orders, numbers = orders[risky], numbers[risky]
            points = np.logical_or(*_breaches(low[risky], resets[risky], initial_equity, mandate, -margin))
            # no point behind the last risky one can break a rule, with slippage there or without
            ends = len(pnl) - np.argmax(points[:, ::-1], axis=1)
        between.extend((n, o[:end].copy()) for n, o, end in zip(numbers.tolist(), orders, ends))
        if sum(len(o) for _, o in between) >= hashing.BLOCK_ROWS:
            settle()
    settle()
    if not failed:
        return 0, None
    number = min(failed)
    daily, dd = _breaches(*exact([(number, sequence(next(places.parts([number]))[1])[0])]), initial_equity, mandate)
    return len(failed), "MANDATE_DAILY_LOSS_BREACH" if daily[0, int(np.argmax(daily[0] | dd[0]))] else "MANDATE_OVERALL_DD_BREACH"


def _stress_whole(trades: DataFrame, total: int, keys: Sequence[str], trade_key: Sequence[str], mandate: dict, initial_equity: float,
                  pip_value: Column, permutations: int, max_slippage_pips: float) -> DataFrame:
    """The stress test of keys that may be taken whole: only the trades are shuffled, each key's permutations are made where its trades are."""
    keys, by = list(keys), [f"_by{i}" for i in range(len(trade_key))]
    rows = trades.select(*keys, F.col("_ident").cast("binary").alias("_ident"), F.col("net_pnl").cast("double").alias("_pnl"), F.datediff("day", F.lit(datetime.date(1970, 1, 1))).alias("_day"),
                         pip_value.cast("double").alias("_pip"), F.col("lots").cast("double").alias("_lots"), *[F.col(c).alias(n) for c, n in zip(trade_key, by)])
    kind = StructType([*[rows.schema[k] for k in keys], StructField("breach_rate_pct", DoubleType()), StructField("first_breach", StringType())])

    def test(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[(c, "ascending") for c in by], null_placement="at_start"))
        number = lambda c, fill: pc.fill_null(group.column(c), fill).to_numpy()
        count, rule = _stress_one(group.column("_ident").to_pylist(), *[number(c, float("nan")) for c in ("_pnl", "_pip", "_lots")],
                                  number("_day", NO_DAY), permutations, max_slippage_pips, initial_equity, mandate)
        return group.slice(0, 1).select(keys).append_column("breach_rate_pct", pa.array([count * 100.0 / permutations])).append_column("first_breach", pa.array([rule], pa.string()))

    tasks = max(1, -(-total * permutations // TASK_PERMUTED))
    return rows.repartition(tasks, *keys).groupBy(*keys).applyInArrow(test, kind)


def stress_test(trades: DataFrame, keys: Sequence[str], trade_key: Sequence[str], mandate: dict, initial_equity: float,
                pip_value: Column, permutations: int = 500, max_slippage_pips: float = 1.5, chunks: int | None = None) -> DataFrame:
    """Breach rate over ``permutations`` reshuffled trade orders with extra slippage, and the rule that the first failing one breaks.

    A permutation is an order by a hash of (permutation, trade), so it needs no driver-side shuffle and
    repeats exactly. A key of up to WHOLE_ROWS trades is tested where its trades are, so permuted trades never leave their task.
    Trades of larger keys are fanned out into chunks, slices of the hash range, equal in size for any key; ``chunks`` does so
    with all keys.
    """
    told = (trades.withColumn("day", mandate_date(F.col("exit_time")))
            .withColumn("_ident", F.concat_ws("|", *[F.col(c).cast("string") for c in trade_key])))
    rest = (keys, trade_key, mandate, initial_equity, pip_value, permutations, max_slippage_pips)
    if chunks is not None:
        return _stress_fanned(told, chunks, *rest)
    endless = lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
    odd = endless(F.col("net_pnl").cast("double")) | endless(F.col("lots").cast("double")) | endless(pip_value.cast("double"))
    sizes = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(odd).alias("_odd"))
    wide = (F.col("_n") > ordered.WHOLE_ROWS) | F.col("_odd")  # numbers that are none compare Spark's way
    found = sizes.agg(F.sum("_n"), F.max("_n"), F.count_if(wide)).first()
    if not found[2]:
        return _stress_whole(told, found[0] or 0, *rest)
    group = F.struct(*keys)
    large = sizes.filter(wide).select(group.alias("_g"))
    told = told.withColumn("_g", group)
    return _stress_whole(told.join(large, "_g", "left_anti").drop("_g"), found[0], *rest).unionByName(
        _stress_fanned(told.join(large, "_g", "left_semi").drop("_g"), -(-found[1] // ordered.CHUNK_ROWS), *rest))


def _stress_fanned(told: DataFrame, chunks: int, keys: Sequence[str], trade_key: Sequence[str], mandate: dict, initial_equity: float,
                   pip_value: Column, permutations: int, max_slippage_pips: float) -> DataFrame:
    """The stress test of keys of any size: all permutations are only tested for a breach; the full path is built for the first failing one of each key."""
    per, order = [*keys, "perm"], ["_place", *trade_key]
    chunk = F.floor(F.col("_place") * chunks)
    fanned = _reshuffled(told.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))), keys, trade_key, pip_value, max_slippage_pips)
    tested = stage(_failing(fanned.drop(*{"exit_time"} - set(order)), per, order, chunk, initial_equity, mandate).groupBy(*keys).agg(
        (F.count_if("failed") * 100.0 / F.count(F.lit(1))).alias("breach_rate_pct"), F.min(F.when(F.col("failed"), F.col("perm"))).alias("perm")))
    group = F.struct(*keys)
    picked = told.withColumn("_g", group).join(tested.where("perm IS NOT NULL").select(group.alias("_g"), "perm"), "_g").drop("_g")
    points = trade_points(_reshuffled(picked, keys, trade_key, pip_value, max_slippage_pips), per, order, chunk, initial_equity, mandate, F.col("_pnl"))
    rule = first_breach(points, per, order, mandate).select(*keys, F.col("breach").alias("first_breach"))
    both = tested.drop("perm").unionByName(rule, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max("breach_rate_pct").alias("breach_rate_pct"), F.max("first_breach").alias("first_breach"))
