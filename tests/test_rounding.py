"""Results are rounded as the SQL rounds them, also where a value lies half-way between two results."""

import datetime

import duckdb
import pytest

from candlewick.plans import ORACLES, QUERIES
from candlewick.plans.bar_queries import rounded

PRICES = [1509.55, 1509.83, 1510.11, 1510.53]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Per account a win and then a loss, whose ratio has a 5 as its seventh and last decimal."""
    d = tmp_path_factory.mktemp("ties")
    day = datetime.datetime(2000, 1, 3)
    rows = [r for s, price in enumerate(PRICES, 1) for r in ((s, 1, s, 1, 1.0, price, 0.1, 0.0, "N", "O", day),
                                                             (s, 2, s, 2, 32.0, 1000.0, 0.04, 0.0, "N", "O", day + datetime.timedelta(days=9)))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(s, f"S{s}", 0, 1.0) for s in range(1, len(PRICES) + 1)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    return str(d)


def test_monitor_rolling_at_ties(spark, folder):
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT strategy_id, trade_no, rolling_pf, rolling_win_rate, rolling_net_pnl FROM ({ORACLES['monitor_rolling']}) ORDER BY 1, 2").fetchall()
    got = QUERIES["monitor_rolling"](spark, folder).select("strategy_id", "trade_no", "rolling_pf", "rolling_win_rate", "rolling_net_pnl").orderBy("strategy_id", "trade_no").collect()
    assert [tuple(r) for r in got] == want


def test_rounded(spark):
    values = [k * 1e-6 + 5e-7 for k in range(4_000_000, 4_400_000, 997)]
    values += [-v for v in values] + [float("inf"), float("nan"), None, 0.0]
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(values)], "i int, v double, n int").coalesce(1)
    got = rounded(df, ["v", "n"])
    assert dict(got.dtypes)["n"] == "int"
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = con.sql("SELECT i, round(v, 6) FROM t ORDER BY i").fetchall()
    assert [(r.i, repr(r.v)) for r in got.orderBy("i").collect()] == [(i, repr(v)) for i, v in want]
