"""Resampling, merging and slicing OHLCV bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.functions.calendar import TIMEFRAME_MINUTES
from candlewick.functions.staging import stage
from candlewick.schemas import OHLCV, require_columns

RESAMPLE_TARGETS = ("M15", "H1", "H4")


def slot_start(ts: Column, seconds: Column | int) -> Column:
    """Left edge of the UTC-aligned slot holding ``ts``."""
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    epoch = F.unix_seconds(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, s))


def ticks_to_bars(ticks: DataFrame, timeframe: str, by_seq: bool = False) -> DataFrame:
    """Bars straight from ticks. ``by_seq`` orders ticks by ``seq`` (needed when times repeat)."""
    place = F.col("seq") if by_seq else F.col("ts")
    slot = slot_start(F.col("ts"), TIMEFRAME_MINUTES[timeframe] * 60)
    return (ticks.groupBy("symbol", slot.alias("_slot"))
            .agg(F.min_by("price", place).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", place).alias("close"),
                 F.sum("volume").alias("volume"), F.avg("spread").alias("spread"))
            .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_slot").alias("ts"),
                    *OHLCV, "spread"))


def is_weekday(ts: Column) -> Column:
    return F.weekday(ts) < 5


def resample(bars: DataFrame, timeframe: str, drop_weekends: bool = True) -> DataFrame:
    """Bars to a longer timeframe, left-closed and left-labelled; empty slots do not appear."""
    return resample_many(bars, [timeframe], drop_weekends)


def resample_many(bars: DataFrame, timeframes: Sequence[str] = RESAMPLE_TARGETS,
                  drop_weekends: bool = True) -> DataFrame:
    """All timeframes from one scan: the shortest is built once, the longer ones from its bars.

    Timeframes must be multiples of the shortest. The second aggregation only sees short bars.
    """
    require_columns(bars, ("symbol", "ts", *OHLCV), "resample")
    minutes = sorted((TIMEFRAME_MINUTES[t], t) for t in timeframes)
    base = minutes[0][0]
    if any(m % base for m, _ in minutes):
        raise ValueError(f"timeframes {timeframes} are not multiples of the shortest")
    source = bars if "spread" in bars.columns else bars.withColumn("spread", F.lit(None).cast("double"))
    short = (source.groupBy("symbol", slot_start(F.col("ts"), base * 60).alias("_slot"))
             .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                  F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
                  F.sum("spread").alias("_spread"), F.count("spread").alias("_n")))
    rules = F.array(*[F.struct(F.lit(t).alias("timeframe"), F.lit(m * 60).alias("seconds")) for m, t in minutes])
    fanned = (short.withColumn("_rule", F.explode(rules))
              .select("symbol", F.col("_rule.timeframe").alias("timeframe"), F.col("_slot").alias("ts"),
                      slot_start(F.col("_slot"), F.col("_rule.seconds")).alias("_bar"),
                      "open", "high", "low", "close", "volume", "_spread", "_n"))
    out = (fanned.groupBy("symbol", "timeframe", "_bar")
           .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
                F.try_divide(F.sum("_spread"), F.sum("_n")).alias("spread"))
           .select("symbol", "timeframe", F.col("_bar").alias("ts"), *OHLCV, "spread")
           .filter(F.col("close").isNotNull()))
    return out.filter(is_weekday(F.col("ts"))) if drop_weekends else out


def merge_history_and_live(history: DataFrame, live: DataFrame, strict: bool = True) -> DataFrame:
    """One bar per (symbol, timeframe, ts); live rows win, then the higher ``seq`` within a source.

    ``strict`` fails the job when a merged price or volume is NULL or NaN.
    """
    for name, df in (("history", history), ("live", live)):
        require_columns(df, ("symbol", "timeframe", "ts", *OHLCV), name)

    def ranked(df: DataFrame, rank: int) -> DataFrame:
        seq = F.col("seq").cast("bigint") if "seq" in df.columns else F.lit(0).cast("bigint")
        return df.select("symbol", "timeframe", "ts", *OHLCV,
                         (F.lit(rank).cast("bigint") * F.lit(1 << 60) + seq).alias("_rank"))

    merged = (ranked(history, 0).unionByName(ranked(live, 1))
              .groupBy("symbol", "timeframe", "ts")
              .agg(*[F.max_by(c, "_rank").alias(c) for c in OHLCV]))
    if not strict:
        return merged
    bad = F.lit(False)
    for c in OHLCV:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    checked = F.when(bad, F.raise_error(F.lit("NaN values in merged OHLCV data"))).otherwise(F.col("close"))
    return merged.withColumn("close", checked)


def price_contradictions(history: DataFrame, live: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Overlap count and largest close difference per symbol and timeframe."""
    key = ["symbol", "timeframe", "ts"]
    h = history.groupBy(*key).agg(F.max("close").alias("_h"))
    lv = live.groupBy(*key).agg(F.max("close").alias("_l"))
    return (h.join(lv, key).groupBy("symbol", "timeframe")
            .agg(F.count(F.lit(1)).alias("overlap"), F.max(F.abs(F.col("_h") - F.col("_l"))).alias("max_close_diff"))
            .withColumn("contradiction", F.col("max_close_diff") > tolerance))


def integrity(bars: DataFrame) -> DataFrame:
    """NULL or NaN count per OHLCV column."""
    require_columns(bars, OHLCV, "integrity")
    return bars.groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"bad_{c}") for c in OHLCV])


def slice_windows(indexed: DataFrame, windows: DataFrame, warmup: int = 250) -> DataFrame:
    """Bars of each window ``[start, end)`` plus the ``warmup`` bars before it (by row count).

    ``windows`` holds symbol, window_id, start, end. Start and end become row numbers first; bars and
    windows then meet on (symbol, block of rows), so a hot symbol is spread over many tasks.
    """
    block = 4096
    edges = window_edges(indexed, windows)
    spans = edges.withColumn("_block", F.explode(F.sequence(
        F.floor(F.greatest(F.col("start_no") - warmup - 1, F.lit(0)) / block),
        F.floor(F.greatest(F.col("end_no") - 1, F.lit(0)) / block))))
    return (indexed.withColumn("_block", F.floor((F.col("row_no") - 1) / block))
            .join(spans, ["symbol", "_block"])
            .filter((F.col("row_no") >= F.col("start_no") - warmup) & (F.col("row_no") < F.col("end_no")))
            .withColumn("is_warmup", F.col("row_no") < F.col("start_no")).drop("_block"))


def window_edges(indexed: DataFrame, windows: DataFrame) -> DataFrame:
    """First row number at or after each window's start and end (one past the last if none).

    Edges and bars are put into one order of time, edges before bars of the same instant; the highest row number so
    far is what lies before an edge. Time is cut into slices of bounded size, so bars and windows never meet in a join.
    """
    points = windows.select("symbol", F.explode(F.array(
        F.struct(F.lit("start_no").alias("edge"), F.col("start").alias("at"), F.col("window_id").alias("id")),
        F.struct(F.lit("end_no").alias("edge"), F.col("end").alias("at"), F.col("window_id").alias("id")))).alias("_p"))
    both = points.select("symbol", F.col("_p.at").alias("_at"), F.lit(None).cast("bigint").alias("_no"), "_p").unionByName(
        indexed.select("symbol", F.col("ts").alias("_at"), F.col("row_no").cast("bigint").alias("_no")), allowMissingColumns=True)
    both = ordered.time_slices(both, ["symbol"], "_at", "_slice", slot=30 * 86400)
    seen = ordered.running(both, ["symbol"], ["_at", "_no", "_p"], F.col("_slice"), {"_before": ("max", F.col("_no"))})
    found = seen.filter(F.col("_p").isNotNull()).select("symbol", F.col("_p.id").alias("window_id"), "_p.edge", (F.coalesce("_before", F.lit(0)) + 1).alias("_first"))
    return found.groupBy("symbol", "window_id").agg(*[F.max(F.when(F.col("edge") == e, F.col("_first"))).alias(e) for e in ("start_no", "end_no")])


def holdout_split(bars: DataFrame, held_out_months: int = 2, opt_months: int = 6, test_months: int = 3,
                  fallback_rows: int = 100) -> DataFrame:
    """Label bars MAIN or HELD_OUT; the held-out tail never eats into what MAIN needs.

    When no month can be spared, HELD_OUT is the last ``fallback_rows`` bars and MAIN keeps all bars
    (``in_main`` and ``in_held_out`` can then both be true). Needs ``row_no``.
    """
    require_columns(bars, ("symbol", "ts", "row_no"), "holdout_split")
    span = bars.groupBy("symbol").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"),
                                      F.max("row_no").alias("_n"))
    days = F.floor((F.unix_seconds("_hi") - F.unix_seconds("_lo")) / 86400)
    months = F.greatest(F.lit(1), F.rint(days / 30.4375).cast("int"))
    held = F.greatest(F.lit(0), F.least(F.lit(held_out_months), months - (opt_months + test_months)))
    span = span.withColumn("held_months", held).withColumn(
        "split_point", F.col("_hi") - F.make_ym_interval(F.lit(0), F.col("held_months")))
    cut = F.col("ts") >= F.col("split_point")
    spare = F.col("held_months") > 0
    return (bars.join(span, "symbol")
            .withColumn("in_main", ~spare | ~cut)
            .withColumn("in_held_out", F.when(spare, cut).otherwise(F.col("row_no") > F.col("_n") - fallback_rows))
            .withColumn("split", F.when(F.col("in_held_out"), "HELD_OUT").otherwise("MAIN"))
            .drop("_lo", "_hi", "_n"))


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Pairs of differently named ranges of a symbol that overlap (columns symbol, name, start, end).

    A sweep in the order of starts: ranges are numbered by start, and a running count of starts, read at each end, tells the last number
    that begins before this end. Partners of a range are the numbers in between, joined by number: as many rows as there are
    overlaps, whatever the number of ranges. Ranges without a start, an end or a symbol overlap with nothing.
    """
    known = ranges.select("symbol", "name", "start", "end").filter("start IS NOT NULL AND end IS NOT NULL")
    sliced = ordered.time_slices(known, ["symbol"], "start", "_slice")
    ranked = stage(ordered.index_rows(sliced, ["symbol"], [F.col(c) for c in ("start", "name", "end")], F.col("_slice"), out="_no").drop("_slice"))
    event = lambda c, side: ranked.select("symbol", F.col(c).alias("_at"), F.lit(side).alias("_start"), "_no")
    events = ordered.time_slices(event("start", 1).unionByName(event("end", 0)), ["symbol"], "_at", "_slice")
    seen = ordered.running(events, ["symbol"], ["_at", "_start", "_no"], F.col("_slice"), {"_last": ("sum", F.col("_start"))}).filter("_start = 0").select("symbol", "_no", "_last")
    n = ordered.CHUNK_ROWS
    first = ranked.join(seen, ["symbol", "_no"]).filter("_last > _no")
    # a range that overlaps very many others is cut into stretches of numbers
    first = first.withColumn("_part", F.explode(F.sequence(F.floor((F.col("_no") + 1) / n), F.floor(F.col("_last") / n))))
    first = first.withColumn("_other", F.explode(F.sequence(F.greatest(F.col("_no") + 1, F.col("_part") * n), F.least("_last", F.col("_part") * n + n - 1))))
    a, b = first.alias("a"), ranked.alias("b")
    both = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a._other") == F.col("b._no"))).filter(
        (F.col("a.name") != F.col("b.name")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    return both.select(F.col("a.symbol").alias("symbol"), F.least("a.name", "b.name").alias("name_a"), F.greatest("a.name", "b.name").alias("name_b"),
                       F.greatest("a.start", "b.start").alias("overlap_start"), F.least("a.end", "b.end").alias("overlap_end"))


def last_closed(indexed: DataFrame, count: int = 300, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The latest ``count`` closed bars per key; the newest bar is still forming and left out."""
    newest = indexed.groupBy(*keys).agg(F.max("row_no").alias("_top"))
    return (indexed.join(newest, list(keys))
            .filter((F.col("row_no") < F.col("_top")) & (F.col("row_no") >= F.col("_top") - count))
            .drop("_top"))
