"""Reading, parsing and writing bar tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators.bars import RESAMPLE_TARGETS, resample_many

_EXPORT_COLUMNS = ("date", "time", "open", "high", "low", "close", "tickvol", "vol", "spread")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars partitioned by symbol and timeframe."""
    return spark.read.parquet(path)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    (bars.repartition("symbol", "timeframe", F.year("ts"))
     .sortWithinPartitions("symbol", "timeframe", "ts")
     .write.mode(mode).partitionBy("symbol", "timeframe").option("compression", "snappy").parquet(path))


def _at(t: datetime | str | Column) -> Column:
    return t if isinstance(t, Column) else F.lit(str(t)).cast("timestamp")


def slice_bars(bars: DataFrame, symbol: str | None = None, timeframe: str | None = None,
               start=None, end=None) -> DataFrame:
    """Rows of ``[start, end]``; every condition reaches the scan."""
    out = bars
    if symbol is not None:
        out = out.filter(F.col("symbol") == symbol)
    if timeframe is not None:
        out = out.filter(F.col("timeframe") == timeframe)
    if start is not None:
        out = out.filter(F.col("ts") >= _at(start))
    if end is not None:
        out = out.filter(F.col("ts") <= _at(end))
    return out


def slice_with_warmup(indexed: DataFrame, start, end=None, warmup: int = 250) -> DataFrame:
    """Rows of ``[start, end]`` plus the ``warmup`` rows before ``start`` of each symbol."""
    first = indexed.groupBy("symbol").agg(F.coalesce(
        F.min(F.when(F.col("ts") >= _at(start), F.col("row_no"))), F.max("row_no") + 1).alias("_first"))
    out = indexed.join(first, "symbol").filter(F.col("row_no") >= F.col("_first") - warmup)
    if end is not None:
        out = out.filter(F.col("ts") <= _at(end))
    return out.withColumn("is_warmup", F.col("row_no") < F.col("_first")).drop("_first")


def available_range(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "timeframe").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("count"))


def read_minute_export(spark: SparkSession, path: str, symbol: Column | None = None) -> DataFrame:
    """Lines of minute exports; the symbol is the part of the file name before the first ``_``."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/_]+)[^/]*$", 1)
    return spark.read.text(path).select((symbol if symbol is not None else name).alias("symbol"),
                                        F.col("value").alias("line"))


def parse_minute_export(lines: DataFrame) -> DataFrame:
    """Typed rows of ``symbol, line``; header lines vanish, ``reject`` says why a row is unusable.

    Among rows of one minute the first in ``line_no`` order counts (lowest line hash without a line
    number), and only then invalid prices are rejected, so a bad first row hides its copies.
    """
    rank = (F.col("line_no").cast("bigint") if "line_no" in lines.columns
            else F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("bigint"))
    # one split per line; later columns only index into it
    body = lines.filter(~F.trim("line").startswith("<") & (F.trim("line") != ""))
    cut = body.select("symbol", rank.alias("_rank"), F.split(F.trim("line"), r"\s+").alias("_part"))
    part = {c: F.get("_part", F.lit(i)) for i, c in enumerate(_EXPORT_COLUMNS)}
    return cut.select(
        "symbol", F.try_to_timestamp(F.concat_ws(" ", part["date"], part["time"]), F.lit("yyyy.MM.dd HH:mm:ss")).alias("ts"),
        *[part[c].try_cast("double").alias(c) for c in ("open", "high", "low", "close")],
        part["tickvol"].try_cast("double").alias("volume"), part["spread"].try_cast("double").alias("spread"), "_rank")


def clean_minute_bars(parsed: DataFrame) -> DataFrame:
    """Unique minutes with a ``reject`` reason (NULL = good). Unparseable times are dropped before."""
    value = ["open", "high", "low", "close", "volume", "spread"]
    once = (parsed.filter(F.col("ts").isNotNull()).groupBy("symbol", "ts")
            .agg(*[F.min_by(c, "_rank").alias(c) for c in value]))
    bad = ((F.col("high") < F.col("low")) | (F.col("open") <= 0) | (F.col("close") <= 0)
           | (F.col("high") <= 0) | (F.col("low") <= 0))
    return once.withColumn("reject", F.when(bad, "INVALID_OHLC"))


def load_minute_export(lines: DataFrame) -> DataFrame:
    return clean_minute_bars(parse_minute_export(lines)).filter("reject IS NULL").drop("reject")


def parse_report(parsed: DataFrame) -> DataFrame:
    """Per symbol: raw rows, bad timestamps, duplicate minutes, invalid rows, clean rows."""
    raw = parsed.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("_n")).groupBy("symbol").agg(
        F.sum("_n").alias("raw_rows"),
        F.coalesce(F.sum(F.when(F.col("ts").isNull(), F.col("_n"))), F.lit(0)).alias("bad_timestamps"),
        F.coalesce(F.sum(F.when(F.col("ts").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("duplicates"))
    good = clean_minute_bars(parsed).groupBy("symbol").agg(
        F.count("reject").alias("invalid_ohlc"), F.count_if(F.col("reject").isNull()).alias("clean_rows"))
    return raw.join(good, "symbol", "left").fillna(0, ["invalid_ohlc", "clean_rows"])


def build_history(lines: DataFrame, timeframes=RESAMPLE_TARGETS) -> DataFrame:
    """Export lines of any number of symbols to bars of every timeframe, in one job."""
    return resample_many(load_minute_export(lines), timeframes)


def build_summary(lines: DataFrame, timeframes=RESAMPLE_TARGETS) -> DataFrame:
    """One row per symbol and timeframe: OK with count and dates, or ERROR when nothing was usable."""
    targets = F.explode(F.array(*[F.lit(t) for t in timeframes]))
    asked = lines.select("symbol").distinct().select("symbol", targets.alias("timeframe"))
    built = build_history(lines, timeframes).groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("candles"), F.to_date(F.min("ts")).alias("start"),
        F.to_date(F.max("ts")).alias("end"))
    return (asked.join(built, ["symbol", "timeframe"], "left")
            .withColumn("status", F.when(F.col("candles").isNull(), "ERROR").otherwise("OK"))
            .fillna(0, ["candles"]))
