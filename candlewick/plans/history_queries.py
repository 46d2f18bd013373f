"""Queries over experiment history and live monitoring."""

from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.functions import ordered
from candlewick.functions.staging import stage
from candlewick.operators import history, metrics, monitor, signals
from candlewick.plans import trade_sql as tsql
from candlewick.plans.bar_queries import nearest, rounded
from candlewick.plans.registry import query
from candlewick.sources import bars as sb

# Orders play search trials: parameters and score derive from the order's keys and price.
_TR = """WITH trials AS MATERIALIZED (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'M15' END AS timeframe, 'fast_ma_period=' || fast || '|sl_atr_multiple=' || sl || '|slow_ma_period=' || slow || '|tp_rr_ratio=' || tp || '|adx_threshold=' || adx AS raw,
 'adx_threshold=' || adx || '|fast_ma_period=' || fast || '|sl_atr_multiple=' || sl || '|slow_ma_period=' || slow || '|tp_rr_ratio=' || tp AS params_text FROM (SELECT *, o_orderdate AS ts, o_orderkey AS trial_number,
 ['ma_crossover', 'rsi_reversion', 'donchian_breakout'][(o_custkey % 3 + 1)::INT] AS template, o_orderpriority AS symbol, o_orderkey % 11 <> 0 AS is_coherent, (o_totalprice % 1000) / 1000 - 0.2 AS score, o_orderstatus AS regime,
 ['5', '10', '20', '40'][(o_orderkey % 4 + 1)::INT] AS fast, ['50', '80', '150'][(o_orderkey // 4 % 3 + 1)::INT] AS slow, ['1.0', '2.0'][(o_orderkey // 12 % 2 + 1)::INT] AS sl, ['1.5', '2.5'][(o_orderkey // 24 % 2 + 1)::INT] AS tp,
 ['0', '15', '20', '30'][(o_custkey % 4 + 1)::INT] AS adx, 'run_' || o_custkey % 60 AS run_id FROM orders))"""


def trials(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda vals, i: F.element_at(F.array(*[F.lit(v) for v in vals]), (i + 1).cast("int"))
    part = lambda n: F.floor(k / n)
    return b.table(spark, d, "orders").select(
        b.utc("o_orderdate").alias("ts"), k.alias("trial_number"), pick(["ma_crossover", "rsi_reversion", "donchian_breakout"], c % 3).alias("template"),
        F.col("o_orderpriority").alias("symbol"), F.when(k % 7 == 0, "unknown").otherwise("M15").alias("timeframe"), (k % 11 != 0).alias("is_coherent"),
        (F.col("o_totalprice") % 1000 / 1000 - 0.2).alias("composite_score"), F.col("o_orderstatus").alias("in_sample_regime"),
        F.concat(F.lit("run_"), c % 60).alias("run_id"), F.create_map(
            F.lit("fast_ma_period"), pick(["5", "10", "20", "40"], k % 4), F.lit("slow_ma_period"), pick(["50", "80", "150"], part(4) % 3),
            F.lit("sl_atr_multiple"), pick(["1.0", "2.0"], part(12) % 2), F.lit("tp_rr_ratio"), pick(["1.5", "2.5"], part(24) % 2),
            F.lit("adx_threshold"), pick(["0", "15", "20", "30"], c % 4)).alias("parameters"))


ORDER = ["ts", "trial_number"]


@query("history_clean_parameters", _TR + " SELECT trial_number, params_text FROM trials")
def history_clean_parameters(spark, d):
    noisy = F.map_concat("parameters", F.create_map(F.lit("pip_size"), F.lit("0.0001"), F.lit("warmup_candles"), F.lit("250")))
    return trials(spark, d).select("trial_number", history.parameter_text(history.clean_parameters(noisy)).alias("params_text"))


@query("history_top_candidates", _TR + """, p AS (SELECT template, symbol, params_text, max(struct_pack(m := (regime = 'O')::INT, s := score)) AS best FROM trials WHERE is_coherent AND score > 0 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY template, symbol ORDER BY best.m DESC, best.s DESC, params_text) AS place FROM p) SELECT template, symbol, place, params_text, best.m = 1 AS regime_match, round(best.s, 6) AS composite_score FROM r WHERE place <= 5""")
def history_top_candidates(spark, d):
    return rounded(history.top_candidates(trials(spark, d), 5, "O", "M15"), ["composite_score"])


_REGION = """'adx_threshold=' || CASE WHEN adx::INT = 0 THEN 'DISABLED' WHEN adx::INT <= 15 THEN 'WEAK' WHEN adx::INT <= 20 THEN 'MODERATE' ELSE 'STRONG' END || '|fast_ma_period=' || CASE WHEN fast::INT <= 15 THEN 'SHORT' WHEN fast::INT <= 30 THEN 'MEDIUM' ELSE 'LONG' END
 || '|sl_atr_multiple=' || CASE WHEN sl::DOUBLE <= 1.5 THEN 'TIGHT' ELSE 'WIDE' END || '|slow_ma_period=' || CASE WHEN slow::INT <= 60 THEN 'MEDIUM' WHEN slow::INT <= 120 THEN 'LONG' ELSE 'EXTRA_LONG' END || '|tp_rr_ratio=' || CASE WHEN tp::DOUBLE <= 2.0 THEN 'LOW' ELSE 'HIGH' END"""


@query("history_region_statistics", _TR + f""", g AS (SELECT *, CASE WHEN template = 'ma_crossover' THEN {_REGION} ELSE '' END AS region, count(*) OVER (PARTITION BY template, symbol) AS total_samples FROM trials)
 SELECT template, symbol, region, count(*) AS count, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, max(total_samples) AS total_samples FROM g WHERE score >= 0 AND total_samples >= 30 GROUP BY template, symbol, region""")
def history_region_statistics(spark, d):
    return rounded(history.region_statistics(trials(spark, d)), ["mean_score", "max_score"])


@query("history_template_performance", _TR + """, l AS (SELECT *, row_number() OVER (PARTITION BY template, symbol ORDER BY ts DESC, trial_number DESC) AS back FROM trials),
 s AS (SELECT template, symbol, count(*) FILTER (back <= 6) AS n, avg(score) FILTER (back <= 3) AS a, avg(score) FILTER (back BETWEEN 4 AND 6) AS o, count(*) AS times_tested, count(*) FILTER (score > 0.7) AS times_promoted, round(greatest(0, max(score)), 6) AS best_score_ever, max(ts) AS last_tested,
 max(ts) FILTER (score > 0.7) AS last_promoted FROM l GROUP BY template, symbol) SELECT template, symbol, times_tested, times_promoted, best_score_ever, last_tested, last_promoted, CASE WHEN n < 6 THEN 'FLAT' WHEN a > o * 1.1 THEN 'UP' WHEN a < o * 0.9 THEN 'DOWN' ELSE 'FLAT' END AS trend FROM s""")
def history_template_performance(spark, d):
    return rounded(history.template_performance(trials(spark, d), ORDER, F.col("composite_score") > 0.7), ["best_score_ever"])


_INS = _TR + """, l AS (SELECT template, symbol, ts, trial_number, score, split_part(kv, '=', 1) AS parameter, split_part(kv, '=', 2) AS value FROM (SELECT *, unnest(string_split(params_text, '|')) AS kv FROM trials)),
 r AS (SELECT *, row_number() OVER (PARTITION BY template, symbol, parameter, value ORDER BY ts DESC, trial_number DESC) AS back FROM l), p AS (SELECT template, symbol, parameter, value, avg(score) AS mean_score, count(*) AS tests FROM r WHERE back <= 10 GROUP BY ALL),
 i AS (SELECT *, row_number() OVER (PARTITION BY template, symbol, parameter ORDER BY mean_score DESC, value) AS place, sum(tests) OVER (PARTITION BY template, symbol, parameter)::BIGINT AS total_tests FROM p),
 ins AS (SELECT *, first_value(value) OVER (PARTITION BY template, symbol, parameter ORDER BY place) AS best_value, CASE WHEN total_tests >= 15 THEN 'HIGH' WHEN total_tests >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM i)"""


@query("history_parameter_insights", _INS + " SELECT template, symbol, parameter, value, round(mean_score, 6) AS mean_score, tests, place, total_tests, best_value, confidence FROM ins")
def history_parameter_insights(spark, d):
    return rounded(history.parameter_insights(trials(spark, d), ORDER), ["mean_score"])


@query("history_good_values", _INS + " SELECT template, symbol, parameter, value, place FROM ins WHERE confidence <> 'LOW' AND place <= 3")
def history_good_values(spark, d):
    return history.good_values(history.parameter_insights(trials(spark, d), ORDER)).select("template", "symbol", "parameter", "value", "place")


@query("history_filter_effectiveness", _TR + """, f AS (SELECT template, symbol AS filter_name, score > 0.5 AS improved, score - 0.5 AS delta, row_number() OVER (PARTITION BY template, symbol ORDER BY ts DESC, trial_number DESC) AS back FROM trials)
 SELECT filter_name, template, count(*) AS applied_count, count(*) FILTER (improved) AS improved_count, round(avg(delta) FILTER (back <= 20), 6) AS avg_improvement, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (improved) / count(*), 6) END AS improvement_rate FROM f GROUP BY ALL""")
def history_filter_effectiveness(spark, d):
    t = trials(spark, d).select("template", F.col("symbol").alias("filter_name"), (F.col("composite_score") > 0.5).alias("improved"), (F.col("composite_score") - 0.5).alias("delta"), *ORDER)
    return rounded(history.filter_effectiveness(t, ORDER), ["avg_improvement", "improvement_rate"])


_PAT = _TR + """, g AS (SELECT regime, template, score * 2 AS pf, score AS win_rate, row_number() OVER (PARTITION BY regime, template ORDER BY ts DESC, trial_number DESC) AS back FROM trials),
 pat AS (SELECT regime, template, avg(pf) AS avg_pf, avg(win_rate) AS avg_win_rate FROM g WHERE back <= 20 GROUP BY ALL)"""


def _patterns(spark, d):
    return history.regime_patterns(trials(spark, d).select(F.col("in_sample_regime").alias("regime"), "template", (F.col("composite_score") * 2).alias("pf"),
                                                           F.col("composite_score").alias("win_rate"), *ORDER), ORDER)


@query("history_regime_patterns", _PAT + " SELECT regime, template, round(avg_pf, 6) AS avg_pf, round(avg_win_rate, 6) AS avg_win_rate FROM pat")
def history_regime_patterns(spark, d):
    return rounded(_patterns(spark, d), ["avg_pf", "avg_win_rate"])


@query("history_best_template", _PAT + " SELECT regime, arg_max(template, avg_pf) AS template FROM pat GROUP BY regime")
def history_best_template(spark, d):
    return history.best_template(_patterns(spark, d))


@query("history_run_trend", """WITH k AS (SELECT c_custkey AS run_no, c_acctbal AS best_score, c_nationkey::DOUBLE AS candidates FROM customer ORDER BY c_custkey DESC LIMIT 50),
 l AS (SELECT run_no, unnest(['best_score', 'candidates']) AS metric, unnest([best_score, candidates]) AS value FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run_no DESC) AS back FROM l) SELECT run_no, metric, value, back FROM r WHERE back <= 5""")
def history_run_trend(spark, d):
    runs = b.table(spark, d, "customer").select(F.col("c_custkey").alias("run_no"), F.col("c_acctbal").alias("best_score"), F.col("c_nationkey").alias("candidates"))
    return history.run_trend(runs, ["best_score", "candidates"], ["run_no"])


@query("history_store_counts", _TR + " SELECT count(DISTINCT run_id) AS total_runs, count(DISTINCT template || raw) AS candidates_tested, count(DISTINCT template || symbol) AS templates_tracked FROM trials")
def history_store_counts(spark, d):
    t = trials(spark, d).withColumn("config_hash", F.concat(F.col("template"), history.parameter_text(F.col("parameters"))))
    return history.store_counts(t)


_HASH = _TR + """, h AS (SELECT *, substr(sha256('{"filters": {}, "parameters": {' || '"adx_threshold": "' || adx || '", "fast_ma_period": "' || fast || '", "sl_atr_multiple": "' || sl || '", "slow_ma_period": "' || slow || '", "tp_rr_ratio": "' || tp || '"}, "symbol": "' || symbol || '", "template": "' || template || '", "timeframe": "' || timeframe || '"}'), 1, 16) AS config_hash FROM trials)"""


def hashed(spark, d):
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return trials(spark, d).withColumn("config_hash", history.config_hash(F.col("template"), F.col("symbol"), F.col("timeframe"), F.col("parameters"), none))


@query("hash_config", _HASH + " SELECT trial_number, config_hash FROM h")
def hash_config(spark, d):
    return hashed(spark, d).select("trial_number", "config_hash")


@query("hash_dna_mismatches", """WITH s AS (SELECT p_partkey AS id, '{"size":' || p_size || ',"type":"' || p_type || '"}' AS pj, '{}' AS fj FROM part), h AS (SELECT *, sha256('{"filters":' || fj || ',"parameters":' || pj || '}') AS good FROM s)
 SELECT id, good AS expected_hash FROM h WHERE id % 9 = 0 OR id % 14 = 0""")
def hash_dna_mismatches(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit('{"size":'), F.col("p_size"), F.lit(',"type":"'), F.col("p_type"), F.lit('"}')).alias("parameters_json"), F.lit("{}").alias("filters_json"))
    stored = history.dna_hash(F.col("parameters_json"), F.col("filters_json"))
    return history.hash_mismatches(p.withColumn("dna_hash", F.when(F.col("id") % 14 == 0, None).when(F.col("id") % 9 == 0, F.lit("bad")).otherwise(stored))).select("id", "expected_hash")


@query("hash_data", b.with_sql("bars") + """ SELECT symbol, timeframe, substr(sha256(symbol || '_' || timeframe || '_' || strftime(min(ts), '%Y-%m-%d %H:%M:%S') || '+00:00_' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') || '+00:00_' || count(*)), 1, 16) AS data_hash FROM bars GROUP BY symbol, timeframe""")
def hash_data(spark, d):
    return history.data_hash(sb.available_range(b.bars(spark, d))).select("symbol", "timeframe", "data_hash")


@query("hash_untested", _HASH + ", t AS (SELECT DISTINCT config_hash, run_id FROM h WHERE score > 0.6) SELECT trial_number FROM h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.config_hash = h.config_hash AND t.run_id = h.run_id)")
def hash_untested(spark, d):
    """The run id stands in for the data hash."""
    h = hashed(spark, d).withColumn("data_hash", F.col("run_id"))
    return history.untested(h, h.filter("composite_score > 0.6")).select("trial_number")


@query("hash_cached_score", _HASH + ", t AS (SELECT config_hash, run_id, max(score) AS cached FROM h WHERE score > 0.6 GROUP BY ALL) SELECT trial_number, round(cached, 6) AS cached_score FROM h LEFT JOIN t USING (config_hash, run_id)")
def hash_cached_score(spark, d):
    h = hashed(spark, d).withColumn("data_hash", F.col("run_id"))
    return rounded(history.with_cached_score(h, h.filter("composite_score > 0.6")).select("trial_number", "cached_score"), ["cached_score"])


# ---- monitoring

ST = ["strategy_id"]


def monitored(spark, d):
    """The numbered trades, and whether strategies are taken whole."""
    t = b.trades(spark, d).withColumnRenamed("account", "strategy_id")
    chunk = b.trade_chunk(t, ST)
    return ordered.index_rows(t, ST, [F.col(c) for c in b.TRADE_ORDER], chunk, out="trade_no").select(*ST, "trade_no", "net_pnl", "exit_time"), chunk is None


def baselines(spark, d):
    s = F.col("s_suppkey")
    return b.table(spark, d, "supplier").select(s.alias("strategy_id"), (1.0 + (s % 5) * 0.2).alias("wf_median_pf"), (0.5 + (s % 3) * 0.1).alias("wf_win_rate"), (0.4 + (s % 4) * 0.08).alias("p0"))


_MON = b.with_sql("trades") + f""", n AS MATERIALIZED (SELECT account AS strategy_id, row_number() OVER (PARTITION BY account ORDER BY {b.TRADE_ORDER_SQL}) AS trade_no, net_pnl FROM trades),
 ro AS MATERIALIZED (SELECT *, count(*) OVER w AS rolling_trades, count(*) FILTER (net_pnl > 0) OVER w / count(*) OVER w AS rolling_win_rate, sum(net_pnl) OVER w AS rolling_net_pnl, CASE WHEN abs(coalesce(sum(net_pnl) FILTER (net_pnl <= 0) OVER w, 0)) > 0
 THEN coalesce(sum(net_pnl) FILTER (net_pnl > 0) OVER w, 0) / abs(sum(net_pnl) FILTER (net_pnl <= 0) OVER w) WHEN count(*) FILTER (net_pnl > 0) OVER w > 0 THEN 'inf'::DOUBLE ELSE 0 END AS rolling_pf,
 coalesce(trade_no - max(trade_no) FILTER (net_pnl > 0) OVER w, count(*) OVER w) AS loss_streak FROM n WINDOW w AS (PARTITION BY strategy_id ORDER BY trade_no ROWS 29 PRECEDING)),
 bl AS (SELECT s_suppkey AS strategy_id, 1.0 + (s_suppkey % 5) * 0.2 AS pf0, 0.5 + (s_suppkey % 3) * 0.1 AS wr0, 0.4 + (s_suppkey % 4) * 0.08 AS p0 FROM supplier),
 kk AS (SELECT *, greatest(0.01, least(p0 - 0.01, p0 * 0.85)) AS p1 FROM bl), kl AS (SELECT *, ln((1 - p1) / (1 - p0)) / ln((p0 * (1 - p1)) / (p1 * (1 - p0))) AS k FROM kk),
 al AS MATERIALIZED (SELECT ro.*, k, CASE WHEN rolling_trades < 20 THEN 0 ELSE (rolling_pf < pf0 * 0.7)::INT + (loss_streak >= 8)::INT + (rolling_win_rate < wr0 * 0.7)::INT END AS n_alerts FROM ro JOIN kl USING (strategy_id)),
 st AS (SELECT strategy_id, 0::BIGINT AS trade_no, 0 AS alert_count, 0.0::DOUBLE AS s, false AS tripped, 'OK' AS level, false AS rerun FROM bl
 UNION ALL SELECT a.strategy_id, a.trade_no, CASE WHEN a.rolling_trades < 20 THEN st.alert_count WHEN a.n_alerts > 0 THEN st.alert_count + 1 ELSE greatest(0, st.alert_count - 1) END,
 greatest(0, st.s + a.k - (a.net_pnl > 0)::INT), st.tripped OR (a.trade_no >= 20 AND greatest(0, st.s + a.k - (a.net_pnl > 0)::INT) >= 12.0),
 CASE WHEN a.rolling_trades < 20 THEN st.level WHEN a.n_alerts > 0 THEN CASE WHEN st.alert_count + 1 >= 3 THEN 'DEGRADED' ELSE 'WARNING' END WHEN greatest(0, st.alert_count - 1) = 0 THEN 'OK' ELSE st.level END,
 CASE WHEN a.rolling_trades < 20 THEN st.rerun WHEN a.n_alerts > 0 AND st.alert_count + 1 >= 3 THEN true WHEN a.n_alerts = 0 AND st.alert_count <= 1 THEN false ELSE st.rerun END FROM st JOIN al a ON a.strategy_id = st.strategy_id AND a.trade_no = st.trade_no + 1)"""


@query("monitor_rolling", _MON + " SELECT strategy_id, trade_no, rolling_trades, round(rolling_win_rate, 6) AS rolling_win_rate, round(rolling_pf, 6) AS rolling_pf, round(rolling_net_pnl, 5) AS rolling_net_pnl, loss_streak FROM ro")
def monitor_rolling(spark, d):
    n, whole = monitored(spark, d)
    r = monitor.rolling(n, ST, whole=whole)
    return rounded(rounded(r, ["rolling_win_rate", "rolling_pf"]), ["rolling_net_pnl"], 5).drop("net_pnl", "exit_time")


@query("monitor_degradation", _MON + """ SELECT st.strategy_id, st.trade_no, al.n_alerts::BIGINT AS n_alerts, st.alert_count, round(s, 6) AS cusum_score, tripped AS cusum_tripped, CASE WHEN tripped THEN 'DEGRADED' ELSE level END AS status, tripped OR rerun AS rerun_recommended
 FROM st JOIN al USING (strategy_id, trade_no) WHERE st.trade_no > 0""")
def monitor_degradation(spark, d):
    n, whole = monitored(spark, d)
    s = monitor.degradation(n, baselines(spark, d), whole=whole)
    return rounded(s.select(*ST, "trade_no", F.size("alerts").cast("bigint").alias("n_alerts"), "alert_count", "cusum_score", "cusum_tripped", "status", "rerun_recommended"), ["cusum_score"])


@query("monitor_cusum_constants", "SELECT s_suppkey AS strategy_id, round(ln((1 - p1) / (1 - p0)) / ln((p0 * (1 - p1)) / (p1 * (1 - p0))), 8) AS k FROM (SELECT *, greatest(0.01, least(p0 - 0.01, p0 * 0.85)) AS p1 FROM (SELECT s_suppkey, 0.4 + (s_suppkey % 4) * 0.08 AS p0 FROM supplier))")
def monitor_cusum_constants(spark, d):
    return baselines(spark, d).select(*ST, nearest(monitor.cusum_reference(F.col("p0")), 8).alias("k"))


@query("monitor_latest_summary", _MON + """ SELECT st.strategy_id, st.trade_no AS total_trades, round(rolling_win_rate, 4) AS rolling_win_rate, round(s, 4) AS cusum_score, tripped AS cusum_tripped, alert_count, max_ls AS max_loss_streak, trip_no
 FROM st JOIN al USING (strategy_id, trade_no) JOIN (SELECT strategy_id, max(trade_no) AS trade_no, max(loss_streak) AS max_ls FROM ro GROUP BY 1) USING (strategy_id, trade_no) LEFT JOIN (SELECT strategy_id, min(trade_no) AS trip_no FROM st WHERE tripped GROUP BY 1) USING (strategy_id)""")
def monitor_latest_summary(spark, d):
    n, whole = monitored(spark, d)
    s = monitor.latest_summary(monitor.degradation(n, baselines(spark, d), whole=whole))
    return rounded(s.select(*ST, F.col("trade_no").alias("total_trades"), "rolling_win_rate", "cusum_score", "cusum_tripped", "alert_count", "max_loss_streak", "trip_no"), ["rolling_win_rate", "cusum_score"], 4)


@query("monitor_staleness", b.with_sql("bars") + """ SELECT symbol, max(ts) AS last_candle, round((epoch(TIMESTAMP '2024-01-30 23:40:00') - epoch(max(ts))) / 60.0, 4) AS age_minutes, (epoch(TIMESTAMP '2024-01-30 23:40:00') - epoch(max(ts))) / 60.0 > 45 AS stale FROM bars GROUP BY symbol""")
def monitor_staleness(spark, d):
    return rounded(monitor.stale(b.bars(spark, d), F.lit("2024-01-30 23:40:00").cast("timestamp")), ["age_minutes"], 4)


@query("monitor_system_status", _MON + """, d AS (SELECT st.*, CASE WHEN tripped THEN 'DEGRADED' ELSE level END AS status, row_number() OVER (PARTITION BY strategy_id ORDER BY trade_no DESC) AS back FROM st WHERE trade_no > 0),
 p AS (SELECT strategy_id, count(*) AS n, sum(net_pnl) AS pnl, count(*) FILTER (net_pnl > 0) AS won FROM (SELECT *, max(trade_no) OVER (PARTITION BY strategy_id) AS top FROM n) WHERE trade_no > top - 50 GROUP BY 1),
 k AS (SELECT strategy_id, count(*) FILTER (net_pnl > 0) / count(*) AS win_rate FROM n GROUP BY 1),
 e AS (SELECT user_id AS strategy_id, arg_max(event_type, event_id) AS regime, arg_max(value, event_id) AS equity, max(event_id) AS seq FROM events GROUP BY 1),
 c AS (SELECT user_id AS strategy_id, max(event_id) AS seq, arg_max(value > 50, event_id) AS promoted FROM events WHERE event_type = 'purchase' GROUP BY 1),
 s AS (SELECT s_suppkey AS strategy_id, s_name AS name, s_acctbal AS score FROM supplier)
 SELECT strategy_id, e.regime AS engine_regime, e.equity AS engine_equity, e.seq AS engine_seq, round(d.s, 5) AS cusum_score, d.tripped::VARCHAR AS cusum_tripped, round(bl.p0, 6) AS cusum_p0, round(k.win_rate, 6) AS cusum_win_rate, d.trade_no AS cusum_n_trades,
 s.name AS strategy_name, s.score AS strategy_score, c.seq AS decision_seq, c.promoted::VARCHAR AS decision_promoted, d.status AS degradation_status, d.alert_count AS degradation_alert_count, p.n AS performance_recent_trades, round(p.pnl, 5) AS performance_total_pnl
 FROM e FULL JOIN (SELECT * FROM d WHERE back = 1) d USING (strategy_id) FULL JOIN (SELECT * FROM s) s USING (strategy_id) FULL JOIN c USING (strategy_id) FULL JOIN p USING (strategy_id) LEFT JOIN k USING (strategy_id) LEFT JOIN bl ON bl.strategy_id = d.strategy_id""")
def monitor_system_status(spark, d):
    """One row per strategy from six sources: engine, detector, strategy, last decision, degradation, performance."""
    (n, whole), base = monitored(spark, d), baselines(spark, d)
    n = stage(n)
    last = stage(monitor.latest_summary(monitor.degradation(n, base, whole=whole)))
    events = b.table(spark, d, "events").withColumnsRenamed({"user_id": "strategy_id", "event_id": "seq"})
    engine = monitor.newest(events.select("strategy_id", "seq", F.col("event_type").alias("regime"), F.col("value").alias("equity")), "strategy_id", ["seq"], ["regime", "equity", "seq"])
    decision = monitor.newest(events.filter("event_type = 'purchase'").withColumn("promoted", (F.col("value") > 50).cast("string")), "strategy_id", ["seq"], ["seq", "promoted"])
    cusum = last.select(*ST, nearest(F.col("cusum_score"), 5).alias("score"), F.col("cusum_tripped").cast("string").alias("tripped"), nearest(F.col("p0"), 6).alias("p0"),
                        nearest(F.col("wins") / F.col("trade_no"), 6).alias("win_rate"), F.col("trade_no").alias("n_trades"))
    strategy = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("strategy_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    perf = metrics.recent_performance(n, ST).select(*ST, "recent_trades", "total_pnl")
    status = monitor.system_status({"engine": engine, "cusum": cusum, "strategy": strategy, "decision": decision, "degradation": last.select(*ST, "status", "alert_count"), "performance": perf})
    return rounded(status, ["performance_total_pnl"], 5)
