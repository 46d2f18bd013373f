"""Bars of one timeframe as a table laid out for its readers.

Rows are numbered per symbol and cut into chunks once, when they are written: every chunk holds its own rows and copies of the
``halo`` rows before them. The table is bucketed by (symbol, chunk), sorted by row number, one file per bucket. A reader's windows over a
chunk find their rows together: reading needs no exchange, whatever the number of symbols, and a hot symbol is as many buckets as it has
chunks. The copies cost halo / size of the space (a quarter with the default, which suits all indicators of a parameter set).

The layout is noted on the column ``_chunk``, where ``ordered.chunked`` finds it: ``indicators.features(bar_store.chunks(spark, name))``.

Defined cases: an empty table of bars gives an empty store; symbols may be NULL; of bars that share symbol and time any order counts,
``append`` refuses bars that are not later than the stored ones of their symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.functions.calendar import timeframe_minutes
from candlewick.functions.staging import stage

# 250 rows of lookback and the averages over 14 bars, one on top of the other
HALO, SIZE = ordered.chunk_plan([[1 / 14, 1 / 14], [1 / 14]], 250)
BUCKET_ROWS = 2_000_000


def _numbered(bars: DataFrame) -> DataFrame:
    seconds = timeframe_minutes(F.col("timeframe")) * 60 * ordered.CHUNK_ROWS
    return ordered.index_rows(bars, ["symbol"], [F.col("ts")], F.floor(F.unix_seconds("ts") / seconds))


def _write(rows: DataFrame, table: str, halo: int, size: int, buckets: int, mode: str, path: str | None) -> None:
    cut = ordered.laid_out(ordered.spread(rows, halo, size), halo, size, buckets=buckets)
    # the exchange of the write deals rows as buckets do, so each bucket is one file
    out = cut.repartition(buckets, "symbol", "_chunk").write.mode(mode).format("parquet").bucketBy(buckets, "symbol", "_chunk").sortBy("symbol", "_chunk", "row_no")
    (out.option("path", path) if path else out).saveAsTable(table)


def save(bars: DataFrame, table: str, path: str | None = None, halo: int = HALO, size: int = SIZE, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write a new store (in ``path``, or managed by the catalogue) with as many buckets as its rows ask for."""
    rows = stage(_numbered(bars))
    _write(rows, table, halo, size, max(1, -(-rows.count() * (halo + size) // (size * bucket_rows))), "overwrite", path)


def append(bars: DataFrame, table: str) -> None:
    """Add later bars. Copies for the chunks that follow are written with every row, so earlier files stay as they are."""
    spark = bars.sparkSession
    have = ordered.layout_of(spark.table(table))
    upto = read(spark, table).groupBy("symbol").agg(F.max("row_no").alias("_rows"), F.max("ts").alias("_upto"))
    new = _numbered(bars).alias("n").join(upto.alias("u"), F.col("n.symbol").eqNullSafe(F.col("u.symbol")), "left")
    late = F.when(F.col("ts") <= F.col("_upto"), F.raise_error(F.concat(F.lit("bar not later than those stored: "), F.col("ts").cast("string"))).cast("bigint"))
    number = F.coalesce(late, F.col("row_no") + F.coalesce("_rows", F.lit(0)))
    rows = stage(new.select(*[F.col(f"n.{c}") for c in bars.columns], number.alias("row_no")))
    _write(rows, table, have["halo"], have["size"], have["buckets"], "append", None)


def chunks(spark: SparkSession, table: str) -> DataFrame:
    """All rows with their chunk, copies included, for operators that take rows in chunks."""
    return spark.table(table)


def read(spark: SparkSession, table: str) -> DataFrame:
    """Every bar once, numbered per symbol."""
    return ordered.own_rows(spark.table(table))
