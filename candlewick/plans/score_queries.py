"""Queries over walk-forward results: scores, gates, decisions, bench."""

from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.functions.staging import stage
from candlewick.operators import mandate, metrics, promotion, scoring
from candlewick.plans import metric_queries as mq
from candlewick.plans.bar_queries import nearest, rounded
from candlewick.plans.registry import query

EQ0, M = b.INITIAL_EQUITY, b.MANDATE
# Half-years of an account's history play the windows of one candidate.
_HALF = "((year(exit_time) - 1995) * 2 + CASE WHEN month(exit_time) > 6 THEN 1 ELSE 0 END)"


def window_trades(spark, d, tasks=None):
    half = (F.year("exit_time") - 1995) * 2 + F.when(F.month("exit_time") > 6, 1).otherwise(0)
    return b.trades(spark, d, tasks).withColumn("window_num", half.cast("bigint")).withColumnRenamed("account", "candidate_id")


def window_metrics(spark, d, days=False):
    """Metrics per candidate and window. Trades of candidates that can be taken whole are shuffled once, by candidate; only then ``days``
    adds the trading days that a window is the one to count."""
    keys = ["candidate_id", "window_num"]
    tasks = b.trade_tasks(spark, d)
    t = window_trades(spark, d, tasks)
    if tasks is None:
        return metrics.summary(t, keys, b.TRADE_ORDER, b.trade_chunk(t, keys[:1]), EQ0)
    if not days:
        return metrics.summary(t, keys, b.TRADE_ORDER, None, EQ0)
    t = t.filter("window_num IS NOT NULL").withColumn("_opens_day", mandate.opens_day(keys[:1]))
    return metrics.summary(t, keys, b.TRADE_ORDER, None, EQ0, more={"new_trading_days": F.count_if("_opens_day")})


def window_results(spark, d, days=False):
    """candidate_id, window_num and the out-of-sample metrics of each window."""
    keys = ["candidate_id", "window_num"]
    m = window_metrics(spark, d, days)
    score = scoring.quick_score(min_trades=10)
    return m.select(
        *keys, F.when(F.col("total_trades") >= 20, "OK").otherwise("INSUFFICIENT_TRADES").alias("status"), F.col("total_trades").alias("oos_trades"),
        F.col("profit_factor").alias("oos_profit_factor"), F.col("calmar_ratio").alias("oos_calmar"), F.col("net_profit").alias("oos_net_profit"),
        F.col("win_rate").alias("oos_win_rate"), F.col("max_drawdown_pct").alias("oos_max_drawdown"),
        F.col("max_consecutive_losses").alias("oos_max_consec_losses"), score.alias("oos_composite_score"),
        (score * 1.1 + 0.01).alias("is_composite_score"), (F.col("max_drawdown_pct") < 8).alias("oos_mandate_compliant"),
        F.when(F.col("max_drawdown_pct") >= 8, F.concat(F.lit("window "), F.col("window_num"))).alias("oos_mandate_breach_reason"),
        *[c for c in m.columns if c == "new_trading_days"])


def quick_sql(dd=8.0, min_trades=10, ramp="0.0"):
    n = lambda x, hi: f"greatest(0.0, least({x}, {hi}))"
    raw = (f"{n('calmar_ratio', 3.0)} / 3.0 * 0.25 + {n('(profit_factor - 1) / 2.0', 1.0)} * 0.20 + {n('sharpe_ratio', 3.0)} / 3.0 * 0.15 + {n('win_rate', 1.0)} * 0.15 + "
           f"{n('net_profit / total_trades / 100.0', 1.0)} * 0.15 + {n(f'1.0 - max_drawdown_pct / {dd}', 1.0)} * 0.10")
    return (f"CASE WHEN max_drawdown_pct > {dd} OR profit_factor <= 1 THEN 0.0 ELSE round(greatest(0.0, least(1.0, ({raw}) * CASE WHEN total_trades < {min_trades} THEN {ramp} ELSE 1.0 END)), 6) END")


_RES = mq._METRICS.replace(b.SQL["trades"], b.SQL["trades"].replace("trades AS (SELECT *,", f"trades AS (SELECT * REPLACE (account * 1000 + {_HALF} AS account),")) + f""",
 mm AS MATERIALIZED (SELECT account // 1000 AS candidate_id, account % 1000 AS window_num, total_trades, win_count / total_trades AS win_rate, CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss ELSE 'inf'::DOUBLE END AS profit_factor,
 net_profit, max_drawdown_pct, max_consecutive_losses, CASE WHEN max_drawdown_pct > 0 THEN annualised_return_pct / max_drawdown_pct ELSE 'inf'::DOUBLE END AS calmar_ratio,
 CASE WHEN total_trades < 2 OR sd = 0 THEN 0.0 ELSE m / sd * sqrt(total_trades / years) END AS sharpe_ratio FROM r),
 res AS MATERIALIZED (SELECT *, CASE WHEN total_trades >= 20 THEN 'OK' ELSE 'INSUFFICIENT_TRADES' END AS status, {quick_sql()} AS score FROM mm),
 ok AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY window_num) AS rk, count(*) OVER (PARTITION BY candidate_id) AS nw FROM res WHERE status = 'OK'),
 sm0 AS (SELECT candidate_id, count(*) AS valid_windows, sum(total_trades)::BIGINT AS total_trades, median(total_trades) AS median_trades_per_window, median(profit_factor) FILTER (profit_factor > 0) AS median_profit_factor,
 median(win_rate) AS median_win_rate, median(calmar_ratio) AS median_calmar_ratio, coalesce(median(profit_factor * (1 - win_rate) / win_rate) FILTER (win_rate > 0 AND win_rate < 1 AND profit_factor > 0), 0) AS median_avg_win_loss,
 median(max_drawdown_pct) AS median_max_drawdown_pct, max(max_drawdown_pct) AS worst_oos_drawdown_pct, count(*) FILTER (net_profit > 0) / count(*) AS profitable_window_rate, max(max_consecutive_losses) AS max_consecutive_losses,
 avg(score) FILTER (rk <= nw // 3) AS early, avg(score) FILTER (rk > nw - nw // 3) AS recent, sum(net_profit) AS total_oos_pnl, bool_and(max_drawdown_pct < 8) AS mandate_compliant,
 min(window_num) FILTER (max_drawdown_pct >= 8) AS bw FROM ok GROUP BY candidate_id),
 sm1 AS (SELECT *, CASE WHEN valid_windows < 3 THEN 0.0 WHEN early > 0 THEN (recent - early) / early * 100 ELSE 0.0 END AS trend FROM sm0),
 sm AS MATERIALIZED (SELECT c.candidate_id, coalesce(valid_windows, 0) AS valid_windows, coalesce(s.total_trades, 0) AS total_trades, coalesce(median_trades_per_window, 0) AS median_trades_per_window, coalesce(median_profit_factor, 0) AS median_profit_factor,
 coalesce(median_calmar_ratio, 0) AS median_calmar_ratio, coalesce(median_avg_win_loss, 0) AS median_avg_win_loss, coalesce(median_max_drawdown_pct, 100) AS median_max_drawdown_pct, worst_oos_drawdown_pct, coalesce(profitable_window_rate, 0) AS profitable_window_rate,
 coalesce(max_consecutive_losses, 99) AS max_consecutive_losses, coalesce(trend, -100) AS temporal_trend_pct, CASE WHEN valid_windows IS NULL THEN false ELSE valid_windows < 3 OR abs(trend) < 30 END AS temporal_stable,
 total_oos_pnl, coalesce(mandate_compliant, true) AS mandate_compliant, CASE WHEN bw IS NOT NULL THEN 'window ' || bw END AS mandate_breach_reason FROM (SELECT DISTINCT candidate_id FROM res) c LEFT JOIN sm1 s USING (candidate_id))"""


@query("score_quick", _RES + " SELECT candidate_id, window_num, score FROM res")
def score_quick(spark, d):
    return window_results(spark, d).select("candidate_id", "window_num", F.col("oos_composite_score").alias("score"))


@query("score_quick_partial", _RES + f", q AS (SELECT *, {quick_sql(20.0, 40, 'pow(total_trades / 40.0, 1.5)')} AS s FROM mm) SELECT candidate_id, window_num, s AS score FROM q")
def score_quick_partial(spark, d):
    return window_metrics(spark, d).select("candidate_id", "window_num", scoring.quick_score(40, 20.0, True).alias("score"))


_SUM_COLS = ["median_trades_per_window", "median_profit_factor", "median_calmar_ratio", "median_avg_win_loss", "median_max_drawdown_pct",
             "worst_oos_drawdown_pct", "profitable_window_rate", "temporal_trend_pct"]


@query("wf_summary", _RES + " SELECT candidate_id, valid_windows, total_trades, max_consecutive_losses, temporal_stable, mandate_compliant, mandate_breach_reason, round(total_oos_pnl, 5) AS total_oos_pnl, " +
       ", ".join(f"round({c}, 5) AS {c}" for c in _SUM_COLS) + " FROM sm")
def wf_summary(spark, d):
    s = scoring.aggregate_windows(window_results(spark, d))
    return rounded(s.select("candidate_id", "valid_windows", "total_trades", "max_consecutive_losses", "temporal_stable", "mandate_compliant",
                            "mandate_breach_reason", "total_oos_pnl", *_SUM_COLS), ["total_oos_pnl", *_SUM_COLS], 5)


_DAYS = f", td AS (SELECT account // 1000 AS candidate_id, count(DISTINCT {mq._DAY.format('entry_time')}) AS trading_days FROM trades GROUP BY 1)"
_FAILED = """CASE WHEN total_trades < 100 THEN 'gate_1_total_trades' WHEN median_trades_per_window < 20 THEN 'gate_2_trades_per_window' WHEN valid_windows < 12 THEN 'gate_3_valid_windows'
 WHEN median_max_drawdown_pct > 20 THEN 'gate_4_max_drawdown' WHEN median_profit_factor < 1.1 THEN 'gate_5_profit_factor' WHEN profitable_window_rate < 0.55 THEN 'gate_6_profitable_windows'
 WHEN max_consecutive_losses > 10 THEN 'gate_7_consecutive_losses' WHEN NOT mandate_compliant THEN 'gate_9_mandate_compliance' WHEN trading_days < 5 THEN 'gate_9_mandate_compliance' END"""
_GATED = _RES + _DAYS + f", g AS MATERIALIZED (SELECT *, {_FAILED} AS failed_gate FROM sm LEFT JOIN td USING (candidate_id))"


def gated(spark, d):
    s = scoring.aggregate_windows(window_results(spark, d, days=True))
    if "trading_days" not in s.columns:
        s = s.join(mandate.trading_days(window_trades(spark, d), ["candidate_id"]), "candidate_id", "left")
    return scoring.hard_gates(s, M)


@query("gates_verdict", _GATED + " SELECT candidate_id, failed_gate IS NULL AS gates_passed, failed_gate FROM g")
def gates_verdict(spark, d):
    return gated(spark, d).select("candidate_id", "gates_passed", "failed_gate")


@query("gates_table", _GATED + """, x AS (SELECT *, unnest([total_trades >= 100, median_trades_per_window >= 20, valid_windows >= 12, median_max_drawdown_pct <= 20, median_profit_factor >= 1.1,
 profitable_window_rate >= 0.55, max_consecutive_losses <= 10, false, mandate_compliant, true, trading_days >= 5, true]) AS passed, unnest(range(1, 13)) AS gate_no FROM g) SELECT candidate_id, gate_no, passed FROM x""")
def gates_table(spark, d):
    return scoring.gate_table(gated(spark, d)).select("candidate_id", "gate_no", "passed")


GATE_PERMUTATIONS = 500
_KEY = "exit_time, order_key, line_no, part_key"
_ID = "concat_ws('|', perm, concat_ws('|', exit_time::VARCHAR, order_key, line_no, part_key))"
_OVER = f"OVER (PARTITION BY cid, perm ORDER BY place, {_KEY} ROWS"
_STRESS = _GATED + f""", k AS MATERIALIZED (SELECT t.account // 1000 AS cid, {_KEY}, perm, {mq._DAY.format('exit_time')} AS day, (('0x' || substr(md5('order|' || {_ID}), 1, 8))::BIGINT / 4294967296.0) AS place,
 net_pnl - (('0x' || substr(md5('slip|' || {_ID}), 1, 8))::BIGINT / 4294967296.0) * 1.5 * 10.0 * lots AS pnl FROM trades t, range(0, {GATE_PERMUTATIONS}) r(perm) WHERE t.account // 1000 IN (SELECT candidate_id FROM g WHERE failed_gate IS NULL)),
 e AS (SELECT *, {EQ0} + sum(pnl) {_OVER} UNBOUNDED PRECEDING) AS equity, max(day) {_OVER} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM k),
 s2 AS (SELECT *, last_value(CASE WHEN pm IS NULL OR day > pm THEN equity END IGNORE NULLS) {_OVER} UNBOUNDED PRECEDING) AS day0 FROM e),
 v AS (SELECT cid, perm, bool_or((CASE WHEN day0 > 0 THEN (day0 - equity) * 100 / day0 ELSE 0 END) >= 4.0 OR ({EQ0} - equity) * 100 / {EQ0} >= 8.0) AS hit FROM s2 GROUP BY ALL),
 rate AS (SELECT cid AS candidate_id, count(*) FILTER (hit) * 100.0 / count(*) AS r FROM v GROUP BY cid)
 SELECT g.candidate_id, g.failed_gate IS NULL AND rate.r <= 3 AS gates_passed, CASE WHEN g.failed_gate IS NOT NULL THEN g.failed_gate WHEN rate.r > 3 THEN 'gate_10_monte_carlo_stress' END AS failed_gate,
 round(rate.r, 4) AS breach_rate_pct FROM g LEFT JOIN rate USING (candidate_id)"""


@query("gates_stress_for_survivors", _STRESS)
def gates_stress_for_survivors(spark, d):
    """Gate 10: the permutation stress runs only for candidates that passed the other gates."""
    first = stage(gated(spark, d))
    t = window_trades(spark, d).join(first.filter("gates_passed").select("candidate_id"), "candidate_id", "left_semi")
    s = mandate.stress_test(t, ["candidate_id"], ["exit_time", "order_key", "line_no", "part_key"], M, EQ0, F.lit(10.0), GATE_PERMUTATIONS)
    return scoring.with_stress(first, s.select("candidate_id", "breach_rate_pct"), M).select(
        "candidate_id", "gates_passed", "failed_gate", nearest(F.col("breach_rate_pct"), 4).alias("breach_rate_pct"))


_SENS = "CASE candidate_id % 3 WHEN 0 THEN 'FRAGILE' WHEN 1 THEN 'ROBUST' ELSE 'MODERATE' END"
_SCORED = _GATED + f""", sc0 AS (SELECT *, {_SENS} AS sens, greatest(0, least(median_calmar_ratio, 3)) / 3 * 0.40 + greatest(0, least(median_profit_factor, 3)) / 3 * 0.25 + greatest(0, least(median_avg_win_loss, 3)) / 3 * 0.15
 + profitable_window_rate * 0.10 + CASE WHEN temporal_stable AND temporal_trend_pct > -10 THEN 1.0 WHEN temporal_stable THEN 0.7 WHEN temporal_trend_pct > 0 THEN 0.6 WHEN temporal_trend_pct <= -20 THEN 0.2 ELSE 0.4 END * 0.05
 + CASE WHEN (candidate_id % 10) / 10.0 >= 0.70 THEN 1.0 WHEN (candidate_id % 10) / 10.0 >= 0.40 THEN 0.6 ELSE 0.2 END * 0.05 AS raw FROM g),
 scored AS MATERIALIZED (SELECT *, round(greatest(0, least(1, raw + CASE sens WHEN 'FRAGILE' THEN -0.10 * raw WHEN 'ROBUST' THEN 0.05 * raw ELSE 0 END - round(least(0.20, 0.04 * log10(100)), 4)
 - CASE WHEN worst_oos_drawdown_pct > 6.8 THEN round(0.10 * least(1.0, (worst_oos_drawdown_pct - 6.8) / 1.2), 4) ELSE 0 END)), 4) AS composite FROM sc0)"""


def scored(spark, d):
    g = gated(spark, d).withColumn("sensitivity_status", F.when(F.col("candidate_id") % 3 == 0, "FRAGILE").when(F.col("candidate_id") % 3 == 1, "ROBUST").otherwise("MODERATE")) \
        .withColumn("tier2_robustness", (F.col("candidate_id") % 10) / 10.0)
    return scoring.composite_score(g, 100)


@query("score_composite", _SCORED + " SELECT candidate_id, round(raw, 6) AS raw_score, composite, CASE WHEN composite >= 0.70 THEN 'EXCELLENT' WHEN composite >= 0.55 THEN 'GOOD' WHEN composite >= 0.40 THEN 'MARGINAL' ELSE 'WEAK' END AS band FROM scored")
def score_composite(spark, d):
    return scored(spark, d).select("candidate_id", nearest(F.col("raw_score"), 6).alias("raw_score"), "composite", scoring.interpretation(F.col("composite")).alias("band"))


@query("score_rank", _SCORED + " SELECT candidate_id, composite, rank() OVER (ORDER BY composite DESC) AS rank FROM scored")
def score_rank(spark, d):
    return scoring.rank_candidates(stage(scored(spark, d).select("candidate_id", "composite"))).select("candidate_id", "composite", "rank")


@query("score_top_candidates", _SCORED + " SELECT candidate_id, composite FROM scored ORDER BY composite DESC, candidate_id LIMIT 10")
def score_top_candidates(spark, d):
    return scored(spark, d).select("candidate_id", "composite").orderBy(F.desc("composite"), "candidate_id").limit(10)


_BASE = "CASE WHEN candidate_id % 4 = 0 THEN 0.0 ELSE 0.45 END"
_DEC = _SCORED + f""", d0 AS (SELECT *, candidate_id % 4 = 0 AS first_run, {_BASE} AS baseline, failed_gate IS NULL AS gp, CASE WHEN candidate_id % 4 = 0 THEN NULL ELSE (composite - 0.45) * 100 / 0.45 END AS imp,
 (median_calmar_ratio < 1.0)::INT + (median_profit_factor < 1.3)::INT + (median_max_drawdown_pct > 18)::INT + (profitable_window_rate < 0.65)::INT + (profitable_window_rate < 0.60)::INT + (sens = 'FRAGILE')::INT AS fails FROM scored),
 dec AS MATERIALIZED (SELECT *, CASE WHEN NOT gp THEN 'AUTO_REJECT' WHEN first_run THEN CASE WHEN composite >= 0.5 THEN 'AUTO_PROMOTE' WHEN composite >= 0.4 THEN 'FLAG_REVIEW' ELSE 'AUTO_REJECT' END
 WHEN imp < 0 THEN 'AUTO_REJECT' WHEN imp >= 20 AND fails = 0 THEN 'AUTO_PROMOTE' ELSE 'FLAG_REVIEW' END AS path FROM d0),
 dc AS MATERIALIZED (SELECT *, CASE path WHEN 'AUTO_PROMOTE' THEN 'PROMOTED' WHEN 'FLAG_REVIEW' THEN 'FLAGGED' ELSE 'REJECTED' END AS outcome,
 CASE WHEN NOT gp THEN 1 WHEN first_run THEN CASE WHEN path = 'FLAG_REVIEW' THEN 1 ELSE 0 END WHEN path = 'AUTO_REJECT' THEN 1 WHEN path = 'AUTO_PROMOTE' THEN 0 ELSE (imp < 20)::INT + fails END AS n_flags FROM dec)"""


def decisions(spark, d):
    s = scored(spark, d).withColumn("first_run", F.col("candidate_id") % 4 == 0).withColumn("baseline_score", F.when(F.col("first_run"), 0.0).otherwise(0.45))
    return promotion.decide(s)


@query("promotion_decisions", _DEC + " SELECT candidate_id, path AS decision_path, outcome AS decision_outcome, n_flags::BIGINT AS n_flags, round(imp, 4) AS improvement_pct FROM dc")
def promotion_decisions(spark, d):
    return decisions(spark, d).select("candidate_id", "decision_path", "decision_outcome", F.size("flags").cast("bigint").alias("n_flags"),
                                      nearest(F.col("improvement_pct"), 4).alias("improvement_pct"))


@query("promotion_records", _DEC + " SELECT candidate_id, substr(sha256('run_' || candidate_id % 5 || '_' || candidate_id), 1, 12) AS decision_id, outcome AS decision_outcome FROM dc")
def promotion_records(spark, d):
    r = promotion.decision_records(decisions(spark, d), F.concat(F.lit("run_"), F.col("candidate_id") % 5))
    return r.select("candidate_id", "decision_id", "decision_outcome")


@query("promotion_run_summary", _DEC + """, s AS (SELECT s_suppkey % 5 AS r, count(*) AS n, count(*) FILTER (s_acctbal < 0 OR s_suppkey % 5 = 4) AS f FROM supplier GROUP BY 1)
 SELECT 'run_' || s.r AS run_id, count(candidate_id) AS candidates_tested, count(*) FILTER (outcome = 'PROMOTED') AS candidates_promoted, count(*) FILTER (outcome = 'FLAGGED') AS candidates_flagged,
 count(*) FILTER (outcome = 'REJECTED') AS candidates_rejected, max(composite) AS best_score, CASE WHEN max(f) = max(n) THEN 'FAILED' WHEN max(f) > 0 THEN 'PARTIAL_FAILURE' ELSE 'COMPLETED' END AS outcome
 FROM s LEFT JOIN dc ON dc.candidate_id % 5 = s.r GROUP BY s.r""")
def promotion_run_summary(spark, d):
    r = promotion.decision_records(decisions(spark, d), F.concat(F.lit("run_"), F.col("candidate_id") % 5))
    sym = b.table(spark, d, "supplier").select(F.concat(F.lit("run_"), F.col("s_suppkey") % 5).alias("run_id"), F.col("s_suppkey").alias("symbol"),
                                               ((F.col("s_acctbal") < 0) | (F.col("s_suppkey") % 5 == 4)).alias("failed"))
    return promotion.run_summary(r, sym).select("run_id", "candidates_tested", "candidates_promoted", "candidates_flagged", "candidates_rejected", "best_score", "outcome")


@query("promotion_report", _DEC + " SELECT candidate_id, outcome AS decision_outcome, CASE WHEN gp THEN 'PASSED' ELSE 'FAILED' END AS gate_status, composite AS composite_score FROM dc")
def promotion_report(spark, d):
    r = stage(promotion.decision_records(decisions(spark, d).withColumn("template", F.lit("ma_crossover")), F.lit("run_1")))
    layers = r.groupBy("run_id", F.lit("gates").alias("layer"), F.lit("OK").alias("status")).agg(F.count(F.lit(1)).cast("string").alias("detail"))
    t = promotion.report_tables(r, layers)
    return t["candidates"].join(t["decisions"], ["run_id", "candidate_id"]).select("candidate_id", "decision_outcome", "gate_status", "composite_score")


@query("wf_degradation_verdict", _RES + """, a AS (SELECT candidate_id, count(*) AS valid_windows, count(*) FILTER (net_profit > 0) * 100.0 / count(*) AS p, list_sort(list(profit_factor) FILTER (profit_factor > 0)) AS l,
 avg(score * 1.1 + 0.01) AS ai, avg(score) AS ao FROM res WHERE status = 'OK' GROUP BY candidate_id), v AS (SELECT *, l[len(l) // 2 + 1] AS mp FROM a)
 SELECT candidate_id, valid_windows, round(p, 4) AS profitable_pct, round(mp, 5) AS median_pf, round((ao - ai) / ai * 100, 4) AS degradation_pct,
 CASE WHEN p >= 60 AND mp >= 1.1 THEN 'PROMISING' WHEN p >= 50 AND mp >= 1.0 THEN 'MARGINAL' WHEN p >= 40 THEN 'WEAK' ELSE 'NO EDGE' END AS verdict FROM v""")
def wf_degradation_verdict(spark, d):
    v = scoring.degradation_verdict(window_results(spark, d))
    return v.select("candidate_id", "valid_windows", nearest(F.col("profitable_pct"), 4).alias("profitable_pct"), nearest(F.col("median_pf"), 5).alias("median_pf"),
                    nearest(F.col("degradation_pct"), 4).alias("degradation_pct"), "verdict")


@query("wf_skipped_windows", _RES + " SELECT candidate_id, status, count(*) AS windows FROM res WHERE status <> 'OK' GROUP BY ALL")
def wf_skipped_windows(spark, d):
    return scoring.skipped_windows(window_results(spark, d))


# ---- bench: parts play stored strategies

_BENCH = """WITH bench AS (SELECT 'S' || p_partkey AS strategy_id, CASE WHEN p_partkey % 40 = 7 THEN 'DEPLOYED' WHEN p_partkey % 3 = 0 THEN 'READY' ELSE 'ARCHIVED' END AS status, p_retailprice AS score, NULL::TIMESTAMP AS deployed_at, NULL::TIMESTAMP AS archived_at FROM part)"""


def bench(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("timestamp")
    return b.table(spark, d, "part").select(F.concat(F.lit("S"), k).alias("strategy_id"), F.when(k % 40 == 7, "DEPLOYED").when(k % 3 == 0, "READY").otherwise("ARCHIVED").alias("status"),
                                            F.col("p_retailprice").alias("score"), none.alias("deployed_at"), none.alias("archived_at"))


@query("bench_upsert", _BENCH + """, ch AS (SELECT 'S' || (s_suppkey * 30) AS strategy_id, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS score FROM supplier)
 SELECT coalesce(ch.strategy_id, bench.strategy_id) AS strategy_id, status, coalesce(ch.score, bench.score) AS score FROM bench FULL JOIN ch USING (strategy_id)""")
def bench_upsert(spark, d):
    ch = b.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey") * 30).alias("strategy_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("score"))
    return promotion.upsert(bench(spark, d), ch).select("strategy_id", "status", "score")


@query("bench_deploy", _BENCH + """ SELECT strategy_id, CASE WHEN strategy_id = 'S9' THEN 'DEPLOYED' WHEN status = 'DEPLOYED' THEN 'ARCHIVED' ELSE status END AS status,
 CASE WHEN strategy_id = 'S9' THEN TIMESTAMP '2024-02-01' END AS deployed_at, CASE WHEN status = 'DEPLOYED' AND strategy_id <> 'S9' THEN TIMESTAMP '2024-02-01' END AS archived_at FROM bench""")
def bench_deploy(spark, d):
    return promotion.deploy(bench(spark, d), "S9", F.lit("2024-02-01").cast("timestamp")).select("strategy_id", "status", "deployed_at", "archived_at")


@query("bench_lookup", _BENCH + " SELECT strategy_id, status FROM bench WHERE status = 'DEPLOYED' OR strategy_id = 'S12'")
def bench_lookup(spark, d):
    t = bench(spark, d)
    return promotion.by_status(t, "deployed").unionByName(promotion.by_id(t, "S12")).select("strategy_id", "status").distinct()


@query("promotion_parameter_diff", """WITH a AS (SELECT p_brand AS template, p_partkey AS id, unnest(['size', 'price', 'type']) AS parameter, unnest([p_size::VARCHAR, round(p_retailprice)::BIGINT::VARCHAR, p_type]) AS v FROM part),
 c AS (SELECT id, parameter, CASE WHEN parameter = 'size' THEN (v::INT + id % 2)::VARCHAR ELSE v END AS v FROM a WHERE parameter <> 'type' UNION ALL SELECT p_partkey, 'rr', '2.0' FROM part)
 SELECT coalesce(a.id, c.id) AS id, coalesce(a.parameter, c.parameter) AS parameter, coalesce(a.v, '—') AS active_value, coalesce(c.v, '—') AS candidate_value, coalesce(a.v, '—') <> coalesce(c.v, '—') AS changed FROM a FULL JOIN c ON a.id = c.id AND a.parameter = c.parameter""")
def promotion_parameter_diff(spark, d):
    p = b.table(spark, d, "part")
    price = F.floor(F.col("p_retailprice") + 0.5).cast("bigint").cast("string")
    act = p.select(F.col("p_partkey").alias("id"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), price, F.lit("type"), F.col("p_type")).alias("parameters"))
    cand = p.select(F.col("p_partkey").alias("id"), F.create_map(F.lit("size"), (F.col("p_size") + F.col("p_partkey") % 2).cast("string"), F.lit("price"), price, F.lit("rr"), F.lit("2.0")).alias("parameters"))
    return promotion.parameter_diff(act, cand, ["id"])
