"""Streaming bars with late-data handling, and signals on every closed bar."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.calendar import TIMEFRAME_MINUTES
from candlewick.operators import indicators as ind
from candlewick.operators import signals
from candlewick.schemas import OHLCV

LIVE_WINDOW = 300


def _from_ticks(ticks: DataFrame, timeframe: str, late_by: str, unique: bool) -> DataFrame:
    t = ticks.withWatermark("ts", late_by)
    if unique:
        t = t.dropDuplicatesWithinWatermark(["symbol", "seq"])
    return t.groupBy("symbol", F.window("ts", f"{TIMEFRAME_MINUTES[timeframe]} minutes")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))


def _labelled(bars: DataFrame, timeframe: str) -> DataFrame:
    return bars.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("window.start").alias("ts"), *OHLCV)


def stream_bars(ticks: DataFrame, timeframe: str = "H1", late_by: str = "10 minutes", unique: bool = True) -> DataFrame:
    """Bars from a tick stream (symbol, ts, price, volume, seq). In append mode a bar appears once the
    watermark has passed its end, so only closed bars are ever seen; later ticks are dropped."""
    return _labelled(_from_ticks(ticks, timeframe, late_by, unique), timeframe)


def bar_chain(ticks: DataFrame, timeframes: Sequence[str] = ("M15", "H1", "H4"), late_by: str = "10 minutes", unique: bool = True) -> dict[str, DataFrame]:
    """Closed bars of several timeframes from one tick stream, each aggregated from the closed bars before it.

    Only the shortest timeframe keeps ticks (as aggregates) in its state; a longer one sees a few closed bars per window, by their
    event time. Each timeframe must be a multiple of the one before. Append mode, like ``stream_bars``.
    """
    out, chain, before = {}, None, 0
    for t in timeframes:
        minutes = TIMEFRAME_MINUTES[t]
        if before and (minutes % before or minutes <= before):
            raise ValueError(f"{t} is no multiple of the timeframe before it")
        if chain is None:
            chain = _from_ticks(ticks, t, late_by, unique)
        else:
            chain = chain.groupBy("symbol", F.window(F.window_time("window"), f"{minutes} minutes")).agg(
                F.min_by("open", F.col("window.start")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                F.max_by("close", F.col("window.start")).alias("close"), F.sum("volume").alias("volume"))
        out[t], before = _labelled(chain, t), minutes
    return out


def as_of_stream(left: DataFrame, bars: DataFrame, left_key: Sequence[str], payload: Sequence[str], max_age: str = "4 hours", late_by: str = "10 minutes") -> DataFrame:
    """Each row of a stream (symbol, ts, ...) with the latest bar closed by then, of a second stream (symbol, at: closing time, ...).

    An interval join with watermarks on both sides, so state older than ``max_age`` and ``late_by`` is dropped; of the bars in reach, the
    aggregation behind the join keeps the newest. Rows without a bar in reach appear with NULLs. ``left_key`` are the columns that make a left row unique.
    """
    ticks = left.withWatermark("ts", late_by)
    closed = bars.select(F.col("symbol").alias("_symbol"), "at", F.struct("at", *payload).alias("_bar")).withWatermark("at", late_by)
    near = (F.col("symbol") == F.col("_symbol")) & (F.col("at") <= F.col("ts")) & (F.col("at") > F.col("ts") - F.expr(f"INTERVAL {max_age}"))
    found = ticks.join(closed, near, "left").groupBy("symbol", *left_key, "ts").agg(F.max_by("_bar", "at").alias("_bar"))
    return found.select("symbol", *left_key, "ts", F.col("_bar.at").alias("as_of_ts"), *[F.col(f"_bar.{c}").alias(c) for c in payload])


def live_signals(bars: DataFrame, template: str, params: dict, lookback: int = LIVE_WINDOW) -> DataFrame:
    """Signal of the newest bar per symbol from its last ``lookback`` bars.

    The lookback bounds a symbol to a few hundred rows; the map side keeps only those per symbol.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    recent = bars.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= lookback)
    size = recent.groupBy("symbol").agg(F.max("_back").alias("_n"))
    numbered = recent.join(size, "symbol").withColumn("row_no", (F.col("_n") - F.col("_back") + 1).cast("bigint")).drop("_n", "_back")
    sig = signals.with_signals(ind.features(numbered, params), template, params, live=True)
    return signals.latest(sig)


def last_bars(bars: DataFrame, lookback: int = LIVE_WINDOW) -> DataFrame:
    """The newest ``lookback`` bars per symbol; the map side already drops what no symbol can need."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= lookback).drop("_back")


def signal_sink(bar_path: str, out_path: str, template: str, params: dict, timeframe: str = "H1",
                lookback: int = LIVE_WINDOW) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: store the closed bars, then evaluate the newest bar per symbol.

    All outputs are folders per batch id, overwritten on a retry, so a replayed batch changes nothing.
    Next to the full history, ``<bar_path>_last`` keeps the newest ``lookback`` bars of every symbol as of each batch: a
    batch reads that of the one before it, so its cost follows the number of symbols, not the length of the
    history. ``timeframe`` is the only one evaluated. Where it is missing (a sink put onto older files), the stored history is read once.
    """

    def before(spark, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        try:
            return spark.read.parquet(f"{bar_path}_last/batch={batch_id - 1}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        return spark.read.option("basePath", bar_path).parquet(bar_path).filter((F.col("batch") < batch_id) & (F.col("timeframe") == timeframe)).drop("batch")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{bar_path}/batch={batch_id}")
        new = spark.read.schema(batch.schema).parquet(f"{bar_path}/batch={batch_id}")
        old = before(spark, batch_id)
        last = f"{bar_path}_last/batch={batch_id}"
        new = new.filter(F.col("timeframe") == timeframe)
        last_bars(new if old is None else old.unionByName(new), lookback).write.mode("overwrite").parquet(last)
        touched = spark.read.schema(batch.schema).parquet(last).join(new.select("symbol").distinct(), "symbol", "left_semi")
        out = live_signals(touched, template, params, lookback)
        out.select("symbol", "ts", "signal", "reason", "sl_price", "tp_price", "session", "regime").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write
