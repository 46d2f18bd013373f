"""Data-quality checks over bars: one grouped job for all symbols and timeframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.functions.calendar import timeframe_minutes

_KEYS = ["symbol", "timeframe"]
MIN_YEARS = 3
MAX_ZERO_VOLUME_PCT = 5


def days_between(lo: Column, hi: Column) -> Column:
    """Whole elapsed days."""
    return F.floor((F.unix_seconds(hi) - F.unix_seconds(lo)) / 86400)


def profile(bars: DataFrame) -> DataFrame:
    years = days_between(F.col("_lo"), F.col("_hi")) / F.lit(365)
    return (bars.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("total_candles"), F.min("ts").alias("_lo"),
                                     F.max("ts").alias("_hi"))
            .select(*_KEYS, "total_candles", F.to_date("_lo").alias("date_start"), F.to_date("_hi").alias("date_end"),
                    F.bround(years, 1).alias("years_covered")))


def duplicates(bars: DataFrame) -> DataFrame:
    """Rows beyond the first of a timestamp."""
    return (bars.groupBy(*_KEYS, "ts").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*_KEYS).agg(F.sum(F.col("_n") - 1).alias("duplicates")))


def ohlc_violation() -> Column:
    return ((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
            | (F.col("high") < F.col("low")))


def gaps(bars: DataFrame) -> DataFrame:
    """Steps longer than 1.5 bars with their class; ``gap_class`` is NULL for unexpected gaps.

    The previous bar comes from a chunk of the calendar plus the last bar of earlier chunks, so no
    task holds a whole symbol.
    """
    seconds = timeframe_minutes(F.col("timeframe")) * 60
    slots = ordered.time_chunk(F.col("ts"), 32 * 86400)
    steps = ordered.running(bars.select(*_KEYS, "ts"), _KEYS, ["ts"], slots,
                            {"gap_start": ("max", F.col("ts"))}, exclusive=True)
    length = F.unix_seconds("ts") - F.unix_seconds("gap_start")
    found = (steps.withColumn("gap_seconds", length).withColumnRenamed("ts", "gap_end")
             .filter(F.col("gap_seconds") > seconds * 1.5))
    start_day, end = F.weekday("gap_start"), F.col("gap_end")
    klass = (F.when(start_day == 4, "WEEKEND_FRIDAY").when(start_day == 5, "WEEKEND_SATURDAY")
             .when(F.col("gap_seconds") <= 4 * 3600, "SHORT")
             .when((F.month(end) == 12) & F.dayofmonth(end).isin(26, 27, 28), "CHRISTMAS")
             .when((F.month(end) == 1) & F.dayofmonth(end).isin(2, 3, 4), "NEW_YEAR")
             .when(F.col("gap_seconds") <= 5 * 86400, "HOLIDAY"))
    return found.withColumn("gap_class", klass)


def largest_gaps(bars: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` longest gaps not starting on Friday and over four hours."""
    return (gaps(bars).filter((F.weekday("gap_start") != 4) & (F.col("gap_seconds") > 4 * 3600))
            .withColumn("weekday", F.date_format("gap_start", "EEEE"))
            .orderBy(F.desc("gap_seconds"), "symbol", "timeframe", "gap_end").limit(n)
            .select(*_KEYS, "gap_start", "gap_end", "gap_seconds", "weekday"))


def check_all(bars: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Counts, findings and status per symbol and timeframe.

    ``expected`` (symbol, timeframe) adds pairs without data as MISSING.
    """
    once = bars.groupBy(*_KEYS, "ts").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(ohlc_violation()).alias("_bad"),
        F.count_if(F.col("volume") == 0).alias("_zero"))
    base = once.groupBy(*_KEYS).agg(
        F.sum("_n").alias("total_candles"), F.min("ts").alias("_lo"), F.max("ts").alias("_hi"),
        F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_bad").alias("ohlc_violations"),
        F.sum("_zero").alias("_zero"))
    gap_counts = gaps(once).groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("gap_class").isNull()).alias("unexpected_gaps"))
    report = (base.join(gap_counts, _KEYS, "left").fillna(0, ["gaps", "unexpected_gaps"])
              .withColumn("date_start", F.to_date("_lo")).withColumn("date_end", F.to_date("_hi"))
              .withColumn("years", days_between(F.col("_lo"), F.col("_hi")) / F.lit(365))
              .withColumn("zero_volume_pct", F.col("_zero") / F.col("total_candles") * 100)
              .drop("_lo", "_hi", "_zero"))
    if expected is not None:
        report = expected.select(*_KEYS).join(report, _KEYS, "left")
    critical = (F.col("unexpected_gaps") > 0) | (F.col("years") < MIN_YEARS)
    issues = (F.col("duplicates") > 0) | (F.col("ohlc_violations") > 0)
    return report.withColumn(
        "status", F.when(F.col("total_candles").isNull(), "MISSING").when(critical, "CRITICAL")
        .when(issues, "ISSUES").when(F.col("zero_volume_pct") > MAX_ZERO_VOLUME_PCT, "WARNINGS").otherwise("OK")
    ).withColumn("findings", F.array_compact(F.array(
        F.when(F.col("unexpected_gaps") > 0, F.concat(F.lit("UNEXPECTED_GAPS:"), F.col("unexpected_gaps"))),
        F.when(F.col("years") < MIN_YEARS, F.lit("SHORT_HISTORY")),
        F.when(F.col("duplicates") > 0, F.concat(F.lit("DUPLICATES:"), F.col("duplicates"))),
        F.when(F.col("ohlc_violations") > 0, F.concat(F.lit("OHLC_VIOLATIONS:"), F.col("ohlc_violations"))),
        F.when(F.col("zero_volume_pct") > MAX_ZERO_VOLUME_PCT, F.lit("HIGH_ZERO_VOLUME")))))
