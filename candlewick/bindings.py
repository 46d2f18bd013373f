"""Bind the driver tables to the domain tables used by the registered queries.

Each binding has an SQL twin (``SQL`` below) so that every oracle query starts from the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import calendar, ordered
from candlewick.schemas import INSTRUMENT

BAR_SECONDS = 3600
INITIAL_EQUITY = 100_000.0
# Full order of an account's trades; equal rows are interchangeable.
TRADE_ORDER = ["exit_time", "order_key", "line_no", "part_key", "price", "discount", "tax"]
TRADE_CHUNK_SECONDS = 3600

# Literal instrument rows for the five event types of the test tables.
SPECS = [
    ("click", 5, 0.001, 100.0, 0.001, 0.01, 0.01, 0.01, 50.0, 20, 12, -5.0, 1.5),
    ("error", 3, 0.01, 100.0, 0.01, 0.05, 0.01, 0.01, 50.0, 10, 20, -2.5, -1.0),
    ("purchase", 2, 0.01, 100.0, 0.01, 0.10, 0.01, 0.01, 100.0, 30, 35, -12.0, 60.0),
    ("signup", 5, 0.001, 100.0, 0.001, 0.02, 0.10, 0.10, 20.0, 0, 15, 0.5, -3.0),
    ("view", 3, 0.01, 100.0, 0.01, 20.0, 0.01, 0.01, 50.0, 10, 18, -1.0, -1.0),
]
MANDATE = {
    "mandate_id": "EVAL-100K", "firm_name": "EVAL", "account_id": "paper_100k",
    "max_daily_loss_pct": 4.0, "max_overall_drawdown_pct": 8.0, "drawdown_type": "static",
    "min_trading_days": 5, "max_daily_risk_pct": 1.0,
    "symbol_universe": ["CLICK", "PURCHASE", "SIGNUP", "VIEW"], "prohibited_patterns": [],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(col: str) -> Column:
    """Zone-less file timestamps are UTC."""
    return F.col(col).cast("timestamp")


def literal_rows(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """Rows as a VALUES relation: the optimizer knows its size and decides on broadcasting itself."""
    body = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(schema.fieldNames())})").select(
        *[F.col(f.name).cast(f.dataType) for f in schema])


def specs(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, SPECS, INSTRUMENT)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), utc("ts").alias("ts"), F.col("value").alias("price"),
        F.lit(1.0).alias("volume"), (F.col("user_id") % 20).cast("double").alias("spread"),
        F.col("event_id").alias("seq"), F.col("user_id"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewick.operators.bars import ticks_to_bars

    return ticks_to_bars(ticks(spark, sf_dir), "H1")


def indexed(b: DataFrame, seconds: int = BAR_SECONDS) -> DataFrame:
    """Bars with their row number per symbol; a chunk holds at most CHUNK_ROWS bars."""
    return ordered.index_rows(b, ["symbol"], [F.col("ts")],
                              ordered.time_chunk(F.col("ts"), seconds * ordered.CHUNK_ROWS))


def indexed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(bars(spark, sf_dir))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of daily bars (symbol = line number of the order line, price = unit price)."""
    from candlewick.operators.bars import ticks_to_bars

    t = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("LN"), F.col("l_linenumber")).alias("symbol"), utc("l_shipdate").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("price"),
        F.col("l_quantity").alias("volume"), (F.col("l_tax") * 100).alias("spread"),
        # a total order of the lines of one day
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax").alias("_line"))
    order = F.conv(F.substring(F.md5("_line"), 1, 13), 16, 10).cast("bigint")
    return ticks_to_bars(t.select("symbol", F.col("day").alias("ts"), "price", "volume", "spread",
                                  order.alias("seq")), "D1", by_seq=True)


def trade_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """``tasks`` for ``trades``, or None where an account is too large to be taken whole."""
    return ordered.tasks_unless_large(table(spark, sf_dir, "lineitem"), ["l_suppkey"])


def trades(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Closed trades of the accounts (suppliers). With ``tasks`` lines are dealt by account to that many, before anything is derived from them."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines if tasks is None else lines.repartition(tasks, "l_suppkey")
    entry = utc("l_shipdate")
    exit_ = F.timestamp_seconds(F.unix_seconds(entry) + (F.col("l_quantity") * 3600).cast("bigint"))
    lots = F.col("l_quantity") / 10
    gross = F.col("l_extendedprice") * (F.col("l_discount") - 0.04)
    return (lines
            .select(F.col("l_suppkey").alias("account"), entry.alias("entry_time"), exit_.alias("exit_time"),
                    F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("direction"),
                    lots.alias("lots"), gross.alias("gross_pnl"), (lots * 7).alias("commission"),
                    F.col("l_returnflag").alias("entry_regime"), F.col("l_orderkey").alias("order_key"),
                    F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_key"),
                    F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
                    F.col("l_tax").alias("tax"))
            .withColumn("net_pnl", F.col("gross_pnl") - F.col("commission"))
            .withColumn("entry_session", calendar.session_label(F.col("entry_time")))
            .withColumn("exit_session", calendar.session_label(F.col("exit_time"))))


def trade_chunk(trades: DataFrame, keys: Sequence[str] = ("account",)) -> Column | None:
    """Slots of hours or more, or None where every account can be taken whole."""
    return ordered.time_chunk_unless_small(trades, keys, F.col("exit_time"), TRADE_CHUNK_SECONDS)


def _values(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else (f"{v}::DOUBLE" if isinstance(v, float) else str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(names)})"


_SESSION_SQL = """CASE WHEN hour({t}) >= 21 THEN 'DEAD_ZONE' WHEN hour({t}) BETWEEN 13 AND 15 THEN 'LONDON_NY_OVERLAP'
 WHEN hour({t}) BETWEEN 7 AND 8 THEN 'LONDON_OPEN' WHEN hour({t}) BETWEEN 9 AND 12 THEN 'LONDON'
 WHEN hour({t}) BETWEEN 16 AND 20 THEN 'NEW_YORK' ELSE 'ASIAN' END"""


def session_sql(ts: str) -> str:
    return _SESSION_SQL.format(t=ts)


SQL = {
    "ticks": """ticks AS (SELECT event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS volume,
        (user_id % 20)::DOUBLE AS spread, event_id AS seq, user_id FROM events)""",
    "bars": """bars AS (SELECT symbol, 'H1' AS timeframe, date_trunc('hour', ts)::TIMESTAMP AS ts,
        arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
        sum(volume) AS volume, avg(spread) AS spread FROM ticks GROUP BY symbol, date_trunc('hour', ts))""",
    "indexed": """indexed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS row_no FROM bars)""",
    "daily": """dticks AS (SELECT 'LN' || l_linenumber AS symbol, l_shipdate AS ts,
        l_extendedprice / l_quantity / 100 AS price, l_quantity AS volume, l_tax * 100 AS spread,
        ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice,
          l_discount, l_tax)), 1, 13))::BIGINT AS seq FROM lineitem),
      bars AS (SELECT symbol, 'D1' AS timeframe, ts, arg_min(price, seq) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume, avg(spread) AS spread
        FROM dticks GROUP BY symbol, ts)""",
    "trades": f"""trades AS (SELECT *, gross_pnl - commission AS net_pnl, {session_sql('entry_time')} AS entry_session,
        {session_sql('exit_time')} AS exit_session FROM (
        SELECT l_suppkey AS account, l_shipdate AS entry_time, l_shipdate + to_hours(l_quantity::INT) AS exit_time,
        CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS direction, l_quantity / 10 AS lots,
        l_extendedprice * (l_discount - 0.04) AS gross_pnl, l_quantity / 10 * 7 AS commission,
        l_returnflag AS entry_regime, l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key,
        l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem))""",
    "specs": "specs AS (" + _values(SPECS, INSTRUMENT.fieldNames()) + ")",
}
TRADE_ORDER_SQL = ", ".join(TRADE_ORDER)


def with_sql(*names: str) -> str:
    """WITH clause opening of the named bindings (bars pull in ticks, indexed pulls in both)."""
    need: list[str] = []
    for n in names:
        for dep in {"bars": ["ticks"], "indexed": ["ticks", "bars"]}.get(n, []) + [n]:
            if dep not in need:
                need.append(dep)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in need)
