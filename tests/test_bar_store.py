"""Bars stored in chunks: round trip, plans without an exchange, later bars."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.operators import indicators as ind
from candlewick.sources import bar_store

SCHEMA = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double, spread double"


def bars(spark, spans):
    rows = []
    for symbol, lo, hi in spans:
        for i in range(lo, hi):
            c = 100 + (i * 37 % 41) / 7 + len(symbol or "")
            rows.append((symbol, "H1", datetime(2020, 1, 1) + timedelta(hours=i), c - 0.2, c + 1, c - 1.3, c, float(i % 9), 1.0))
    return spark.createDataFrame(rows, SCHEMA)


def numbered(df):
    return ordered.index_rows(df, ["symbol"], [F.col("ts")], F.lit(0))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def table(spark, tmp_path):
    name = f"bars_{uuid.uuid4().hex}"
    yield name, str(tmp_path / "store")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip_and_features_without_exchange(spark, table):
    name, path = table
    b = bars(spark, [("hot", 0, 900), ("A", 0, 30), (None, 0, 3)])
    halo, size = ordered.chunk_plan([[1 / 14, 1 / 14], [1 / 14]], 120)
    bar_store.save(b, name, path, halo, size, bucket_rows=400)
    layout = ordered.layout_of(bar_store.chunks(spark, name))
    assert (layout["halo"], layout["size"], layout["buckets"]) == (halo, size, 3)
    assert rows(bar_store.read(spark, name)) == rows(numbered(b))
    feats = ind.features(bar_store.chunks(spark, name).filter("symbol IS NOT NULL"))
    assert "Exchange" not in plan(feats) and "Exchange" in plan(ind.features(numbered(b)))
    cols = ["symbol", "ts", *[F.round(c, 9).alias(c) for c in ("sma_fast", "sma_slow", "rsi", "atr", "adx", "bb_pct")], "regime"]
    assert rows(feats.select(cols)) == rows(ind.features(numbered(b.filter("symbol IS NOT NULL"))).select(cols))


def test_small_chunks_give_the_same_windows(spark, table):
    """Many chunks of a hot symbol; windows that the stored halo covers, and one that it does not."""
    name, path = table
    b = bars(spark, [("hot", 0, 400), ("A", 0, 7)])
    bar_store.save(b, name, path, halo=25, size=40, bucket_rows=100)
    for period, free in ((20, True), (60, False)):
        got = ind.sma(bar_store.chunks(spark, name), period)
        assert ("Exchange" not in plan(got)) == free
        assert rows(got.select("symbol", "ts", F.round("sma", 9).alias("v"))) == rows(ind.sma(numbered(b), period).select("symbol", "ts", F.round("sma", 9).alias("v")))
    got = ind.ema(bar_store.chunks(spark, name), 10)
    assert rows(got.select("symbol", "ts", F.round("ema", 9).alias("v"))) == rows(ind.ema(numbered(b), 10).select("symbol", "ts", F.round("ema", 9).alias("v")))


def test_append_continues_numbers_and_copies(spark, table):
    name, path = table
    bar_store.save(bars(spark, [("hot", 0, 95), (None, 0, 5)]), name, path, halo=25, size=40, bucket_rows=100)
    bar_store.append(bars(spark, [("hot", 95, 200), ("new", 0, 50), (None, 5, 9)]), name)
    b = bars(spark, [("hot", 0, 200), ("new", 0, 50), (None, 0, 9)])
    assert rows(bar_store.read(spark, name)) == rows(numbered(b))
    assert rows(ind.sma(bar_store.chunks(spark, name), 20).select("symbol", "ts", F.round("sma", 9).alias("v"))) == rows(ind.sma(numbered(b), 20).select("symbol", "ts", F.round("sma", 9).alias("v")))
    with pytest.raises(PySparkException, match="not later"):
        bar_store.append(bars(spark, [("hot", 199, 201)]), name)


def test_empty(spark, table):
    name, path = table
    bar_store.save(bars(spark, [("x", 0, 1)]).limit(0), name, path)
    assert bar_store.read(spark, name).count() == 0
