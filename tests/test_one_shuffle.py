"""Window results, gates, scores and decisions move each trade once: lines are dealt by account, everything else follows where they are."""

import datetime

import pytest
from pyspark.sql import functions as F

from candlewick.functions import ordered
from candlewick.operators import mandate, metrics, scoring
from candlewick.plans import QUERIES

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted([tuple(None if v is None else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect()], key=str)


@pytest.mark.parametrize("name", ["wf_summary", "gates_table", "gates_verdict", "score_composite", "promotion_decisions", "promotion_records"])
def test_trades_are_shuffled_once(spark, name):
    plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Exchange hashpartitioning(l_suppkey" in plan


@pytest.fixture(scope="module")
def trades(spark):
    """Runs of losses, trades without a P&L, keys that are NULL."""
    start = datetime.datetime(2024, 1, 1)
    pnl = [5.0, -1.0, None, -2.0, 0.0, 3.0, -4.0, None, None, -1.0]
    data = [(None if a == 3 else f"a{a}", None if i == 9 and a else i % 2, i, pnl[(i * (a + 1)) % 10], start + datetime.timedelta(hours=7 * i),
             start + datetime.timedelta(hours=7 * i + 30)) for a in range(4) for i in range(40)]
    return spark.createDataFrame(data, "account string, win int, no int, net_pnl double, entry_time timestamp, exit_time timestamp").cache()


def test_whole_keys_and_chunks_agree(trades):
    summary = lambda c: rows(metrics.summary(trades, ["account", "win"], ["no"], c, 1e5, more={"n": F.count_if(F.col("net_pnl").isNull())}))
    assert summary(None) == summary(F.floor(F.col("no") / 7)) and len(summary(None)) == 6
    by_hand = {}
    for r in sorted(trades.filter("account IS NOT NULL AND win IS NOT NULL").collect(), key=lambda r: r.no):
        run, most = by_hand.get((r.account, r.win), (0, 0))
        run = run if r.net_pnl is None else 0 if r.net_pnl > 0 else run + 1
        by_hand[r.account, r.win] = run, max(run, most)
    got = metrics.summary(trades, ["account", "win"], ["no"], None, 1e5).select("account", "win", "max_consecutive_losses").collect()
    assert {(r[0], r[1]): r[2] for r in got} == {k: most for k, (_, most) in by_hand.items()}


def test_days_are_counted_once_per_key(trades):
    per = trades.filter("win IS NOT NULL").withColumn("_o", mandate.opens_day(["account"])).groupBy("account").agg(F.count_if("_o"))
    assert rows(per) == rows(mandate.trading_days(trades.filter("win IS NOT NULL"), ["account"]))


def test_candidates_without_a_valid_window(spark):
    cols = ("candidate_id int, window_num int, status string, oos_trades int, oos_profit_factor double, oos_win_rate double, oos_calmar double, oos_max_drawdown double, "
            "oos_max_consec_losses int, oos_net_profit double, oos_composite_score double, oos_mandate_compliant boolean, oos_mandate_breach_reason string, new_trading_days int")
    w = lambda c, n, s, x, fine=True: (c, n, s, 30, 1.0 + x, 0.5, x, 9.0 if not fine else 2.0, 3, x, x, fine, None if fine else f"window {n}", 4)
    found = spark.createDataFrame([w(1, 1, "OK", 1.0), w(1, 2, "INSUFFICIENT_TRADES", 9.0, False), w(1, 3, "OK", 2.0), w(1, 4, "OK", 4.0), w(2, 1, None, 1.0), w(None, 1, "OK", 1.0)], cols)
    got = {r["candidate_id"]: r for r in scoring.aggregate_windows(found).collect()}
    assert (got[1]["valid_windows"], got[1]["total_trades"], got[1]["median_calmar_ratio"], got[1]["temporal_trend_pct"], got[1]["trading_days"]) == (3, 90, 2.0, 300.0, 16)
    assert got[1]["mandate_compliant"] and got[1]["mandate_breach_reason"] is None and got[1]["worst_oos_drawdown_pct"] == 2.0
    for c in (2, None):  # as in the SQL, whose join finds no summary for a NULL key
        assert {k: got[c][k] for k in scoring.EMPTY_SUMMARY} == scoring.EMPTY_SUMMARY and got[c]["total_oos_pnl"] is None and got[c]["trading_days"] == 4


def test_tasks_follow_the_rows(spark):
    keyed = spark.range(1000).withColumn("k", F.col("id") % 50)
    assert ordered.tasks_unless_large(keyed, ["k"], rows=20) == 50
    assert ordered.tasks_unless_large(keyed, ["k"], rows=19) is None
    assert ordered.tasks_unless_large(keyed.limit(0), ["k"]) == spark.sparkContext.defaultParallelism
