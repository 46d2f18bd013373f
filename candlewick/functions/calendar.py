"""Time and calendar columns: sessions, broker time, trading days, rollovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BROKER_ZONE = "Europe/Bucharest"
MANDATE_ZONE = "Europe/Prague"

# Minutes per timeframe name.
TIMEFRAME_MINUTES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440}


def timeframe_minutes(name: Column) -> Column:
    """Minutes of a timeframe name; NULL when unknown."""
    out = F.lit(None).cast("int")
    for tf, minutes in TIMEFRAME_MINUTES.items():
        out = F.when(F.upper(name) == tf, F.lit(minutes)).otherwise(out)
    return out


def day_of_week(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


# UTC hours [from, to) of each session; every other hour is ASIAN. A NY_OPEN label exists
# in the cost tables, but the overlap session covers all of its hours.
SESSION_HOURS = [(7, 9, "LONDON_OPEN"), (9, 13, "LONDON"), (13, 16, "LONDON_NY_OVERLAP"), (16, 21, "NEW_YORK"), (21, 24, "DEAD_ZONE")]


def session_label(ts: Column) -> Column:
    """Session of a UTC timestamp by its hour."""
    hour = F.hour(ts)
    label = F.lit("ASIAN")
    for lo, hi, name in SESSION_HOURS:
        label = F.when((hour >= lo) & (hour < hi), name).otherwise(label)
    return label


def broker_to_utc(local: Column) -> Column:
    return F.to_utc_timestamp(local.cast("timestamp"), BROKER_ZONE)


def utc_to_broker(utc: Column) -> Column:
    return F.from_utc_timestamp(utc.cast("timestamp"), BROKER_ZONE)


def broker_offset_hours(local: Column) -> Column:
    """Hours the broker clock is ahead of UTC at a broker-local time."""
    ts = local.cast("timestamp")
    return (F.unix_seconds(ts) - F.unix_seconds(broker_to_utc(ts))) / F.lit(3600)


def mandate_date(utc: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(utc, MANDATE_ZONE))


def broker_column_to_utc(df: DataFrame, series: list[str], seq: str, local: str, out: str = "ts_utc") -> DataFrame:
    """Convert a whole broker-time column, row order ``seq`` deciding the repeated autumn hour.

    The repeated hour is read a second time once the local clock has stepped back inside it; the
    missing spring hour moves forward to the instant of the change. Only rows of a repeated hour are
    ordered, one hour of one series at a time.
    """
    ts = F.col(local).cast("timestamp")
    first_pass = broker_to_utc(ts)
    later = first_pass + F.expr("INTERVAL 1 HOUR")
    repeated = utc_to_broker(later) == ts
    missing = utc_to_broker(first_pass) != ts
    slot = Window.partitionBy(*series, F.to_date(ts), "_repeated").orderBy(seq)
    base = df.withColumn("_repeated", repeated)
    folded = (base.filter("_repeated")
              .withColumn("_back", (ts < F.lag(ts).over(slot)).cast("int"))
              .withColumn("_second", F.coalesce(
                  F.sum("_back").over(slot.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) > 0)
              .withColumn(out, F.when(F.col("_second"), later).otherwise(first_pass))
              .withColumn("dst_rule", F.when(F.col("_second"), "REPEATED_SECOND").otherwise("REPEATED_FIRST"))
              .drop("_back", "_second"))
    plain = (base.filter("NOT _repeated")
             .withColumn(out, F.when(missing, F.date_trunc("hour", first_pass)).otherwise(first_pass))
             .withColumn("dst_rule", F.when(missing, "MISSING_SHIFTED").otherwise("REGULAR")))
    return plain.unionByName(folded).drop("_repeated")


def rollover_nights(entry: Column, exit_: Column) -> Column:
    """Swap nights between two times: 21:00 UTC marks strictly after entry and before exit.

    Wednesday counts three times, Saturday and Sunday not at all. Closed form over whole weeks, so a
    long position costs no more than a short one.
    """
    shift = F.lit(21 * 3600)
    first = F.floor((F.unix_seconds(entry) - shift) / F.lit(86400)) + 1
    end = F.ceil((F.unix_micros(exit_) / F.lit(1_000_000) - shift) / F.lit(86400))
    return F.greatest(_nights_until(end) - _nights_until(first), F.lit(0))


def _nights_until(day: Column) -> Column:
    """Weighted nights on days 0 .. day-1 (day 0 = Thursday 1970-01-01); seven per week."""
    full, rest = F.floor(day / F.lit(7)), F.pmod(day, F.lit(7))
    # Cumulated weights from Thursday on: Thu 1, Fri 1, Sat 0, Sun 0, Mon 1, Tue 1, Wed 3.
    inside = F.element_at(F.array(*[F.lit(v) for v in (0, 1, 2, 2, 2, 3, 4)]), (rest + 1).cast("int"))
    return full * F.lit(7) + inside


def elapsed_years(start: Column, end: Column) -> Column:
    """Wall-clock years, at least one trading day."""
    return F.greatest((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6) / F.lit(365.25 * 86400),
                      F.lit(1.0 / 252))


def day_rollover(df: DataFrame, keys: list[str], ts: str, value: str, day: Column,
                 chunk_seconds: int = 6 * 3600) -> DataFrame:
    """Flag the first row of each new day and attach the day's first ``value`` (daily reset).

    Days are small against the whole history, but a hot key's day is still split: the first value of
    a day comes from an aggregate, and the flag from the row time against the day's first time.
    """
    tagged = df.withColumn("day", day)
    starts = tagged.groupBy(*keys, "day").agg(F.min(ts).alias("_first_ts"),
                                              F.min_by(value, ts).alias("day_start_value"))
    first_day = starts.groupBy(*keys).agg(F.min("day").alias("_first_day"))
    days = starts.join(first_day, keys)
    return (tagged.join(days, [*keys, "day"])
            .withColumn("is_rollover", (F.col(ts) == F.col("_first_ts")) & (F.col("day") > F.col("_first_day")))
            .drop("_first_ts", "_first_day"))
