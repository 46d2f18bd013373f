"""Queries over closed trades: equity, metrics, risk limits."""

from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.functions import ordered
from candlewick.operators import mandate, metrics, paths
from candlewick.plans.bar_queries import nearest, rounded
from candlewick.plans.registry import query

ACC, ORDER, EQ0 = ["account"], b.TRADE_ORDER, b.INITIAL_EQUITY
M = b.MANDATE
_W = f"PARTITION BY account ORDER BY {b.TRADE_ORDER_SQL} ROWS UNBOUNDED PRECEDING"
_PATH = b.with_sql("trades") + f""", tn AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY {b.TRADE_ORDER_SQL}) AS seq FROM trades),
 eq AS (SELECT *, {EQ0} + sum(net_pnl) OVER (PARTITION BY account ORDER BY seq ROWS UNBOUNDED PRECEDING) AS equity FROM tn),
 path AS MATERIALIZED (SELECT *, greatest({EQ0}, max(equity) OVER (PARTITION BY account ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak_equity FROM eq)"""
# rounding hides the last digits, where the order of additions shows
_KEY = "account, order_key, line_no, part_key, price"


def numbered(spark, d):
    t = b.trades(spark, d)
    return ordered.index_rows(t, ACC, [F.col(c) for c in ORDER], b.trade_chunk(t), out="trade_no")


@query("metrics_equity_curve", _PATH + f""" SELECT account, seq, exit_time AS time, round(equity, 5) AS equity FROM path
 UNION ALL SELECT account, 0, entry_time, {EQ0} FROM tn WHERE seq = 1""")
def metrics_equity_curve(spark, d):
    t = b.trades(spark, d)
    c = paths.equity_curve(t, ACC, ORDER, b.trade_chunk(t), EQ0, digits=5)
    return c


@query("metrics_drawdown_path", _PATH + f" SELECT {_KEY}, round(equity, 5) AS equity, round(peak_equity, 5) AS peak_equity, round(peak_equity - equity, 5) AS drawdown FROM path")
def metrics_drawdown_path(spark, d):
    t = b.trades(spark, d)
    p = paths.equity_path(t, ACC, ORDER, b.trade_chunk(t), EQ0)
    cols = ["equity", "peak_equity", "drawdown"]
    return rounded(p.select(*_KEY.split(", "), *cols), cols, 5)


_METRICS = _PATH + f""", isl AS (SELECT *, sum(CASE WHEN net_pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY seq ROWS UNBOUNDED PRECEDING) AS wins FROM path),
 runs AS (SELECT account, max(n) AS max_consecutive_losses FROM (SELECT account, wins, count(*) FILTER (net_pnl <= 0) AS n FROM isl GROUP BY ALL) GROUP BY account),
 agg AS (SELECT account, count(*) AS total_trades, count(*) FILTER (net_pnl > 0) AS win_count, count(*) FILTER (net_pnl <= 0) AS loss_count,
 sum(net_pnl) FILTER (net_pnl > 0) AS gross_profit, abs(sum(net_pnl) FILTER (net_pnl <= 0)) AS gross_loss, sum(net_pnl) AS net_profit,
 avg(net_pnl) FILTER (net_pnl > 0) AS avg_win, abs(avg(net_pnl) FILTER (net_pnl <= 0)) AS avg_loss, avg(net_pnl) AS m, stddev_samp(net_pnl) AS sd,
 max(peak_equity - equity) AS max_drawdown_usd, sqrt(sum(pow((peak_equity - equity) / peak_equity * 100, 2)) / (count(*) + 1)) AS ulcer_index,
 greatest((epoch(max(exit_time)) - epoch(min(entry_time))) / (365.25 * 86400), 1.0 / 252) AS years FROM path GROUP BY account),
 r AS (SELECT agg.*, max_consecutive_losses, max_drawdown_usd / {EQ0} * 100 AS max_drawdown_pct, net_profit / {EQ0} * 100 AS total_return_pct,
 CASE WHEN 1 + net_profit / {EQ0} > 0 THEN (pow(1 + net_profit / {EQ0}, 1 / years) - 1) * 100 END AS annualised_return_pct FROM agg JOIN runs USING (account))"""
_MSEL = """ account, total_trades, win_count, loss_count, round(win_count / total_trades, 4) AS win_rate, round(gross_profit, 5) AS gross_profit,
 round(gross_loss, 5) AS gross_loss, round(net_profit, 5) AS net_profit, round(gross_profit / gross_loss, 4) AS profit_factor, round(avg_win, 5) AS avg_win, round(avg_loss, 5) AS avg_loss,
 round(avg_win / avg_loss, 4) AS avg_win_loss_ratio, round(total_return_pct, 8) AS total_return_pct, round(annualised_return_pct, 4) AS annualised_return_pct, round(max_drawdown_usd, 5) AS max_drawdown_usd,
 round(max_drawdown_pct, 8) AS max_drawdown_pct, max_consecutive_losses, round(ulcer_index, 4) AS ulcer_index, round(annualised_return_pct / max_drawdown_pct, 4) AS calmar_ratio,
 round(m / sd * sqrt(total_trades / years), 4) AS sharpe_ratio FROM r"""
_MONEY = ["gross_profit", "gross_loss", "net_profit", "avg_win", "avg_loss", "max_drawdown_usd"]


def rounded_metrics(df):
    return df.withColumns({c: nearest(F.col(c), 5 if c in _MONEY else 8 if c in ("total_return_pct", "max_drawdown_pct") else n) for c, n in metrics.ROUNDING.items()})


@query("metrics_summary", _METRICS + " SELECT" + _MSEL)
def metrics_summary(spark, d):
    t = b.trades(spark, d)
    return rounded_metrics(metrics.summary(t, ACC, ORDER, b.trade_chunk(t), EQ0))


@query("metrics_window_bounds", _METRICS.replace("(epoch(max(exit_time)) - epoch(min(entry_time)))", "(epoch(TIMESTAMP '2003-01-01') - epoch(TIMESTAMP '1995-01-01'))") + " SELECT" + _MSEL)
def metrics_window_bounds(spark, d):
    """Annualised over a given evaluation period instead of first entry to last exit."""
    t = b.trades(spark, d).withColumns({"lo": F.lit("1995-01-01").cast("timestamp"), "hi": F.lit("2003-01-01").cast("timestamp")})
    return rounded_metrics(metrics.summary(t, ACC, ORDER, b.trade_chunk(t), EQ0, window=("lo", "hi")))


@query("metrics_zero_rows", b.with_sql("trades") + """ SELECT c_custkey AS account, coalesce(n, 0) AS total_trades, round(coalesce(p, 0), 5) AS net_profit
 FROM customer LEFT JOIN (SELECT account, count(*) AS n, sum(net_pnl) AS p FROM trades GROUP BY account) t ON t.account = c_custkey""")
def metrics_zero_rows(spark, d):
    keys = b.table(spark, d, "customer").select(F.col("c_custkey").alias("account"))
    t = b.trades(spark, d)
    m = metrics.summary(t, ACC, ORDER, b.trade_chunk(t), EQ0)
    return rounded(metrics.with_zero_rows(keys, m, ACC).select("account", "total_trades", "net_profit"), ["net_profit"], 5)


@query("metrics_recent_performance", _PATH + """, l AS (SELECT *, max(seq) OVER (PARTITION BY account) AS top FROM tn) SELECT account, count(*) AS recent_trades,
 round(count(*) FILTER (net_pnl > 0) / count(*), 4) AS win_rate, round(sum(net_pnl), 5) AS total_pnl,
 round(CASE WHEN sum(net_pnl) FILTER (net_pnl < 0) < 0 THEN sum(net_pnl) FILTER (net_pnl > 0) / abs(sum(net_pnl) FILTER (net_pnl < 0)) ELSE 0 END, 3) AS profit_factor
 FROM l WHERE seq > top - 50 GROUP BY account""")
def metrics_recent_performance(spark, d):
    r = metrics.recent_performance(numbered(spark, d), ACC)
    return rounded(rounded(rounded(r, ["total_pnl"], 5), ["win_rate"], 4), ["profit_factor"], 3)


_BD = """count(*) AS total_trades, count(*) FILTER (net_pnl > 0) AS win_count, count(*) FILTER (net_pnl <= 0) AS loss_count, round(coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0), 5) AS gross_profit,
 round(abs(coalesce(sum(net_pnl) FILTER (net_pnl <= 0), 0)), 5) AS gross_loss, round(sum(net_pnl), 5) AS net_profit, round(count(*) FILTER (net_pnl > 0) / count(*), 4) AS win_rate,
 round(sum(net_pnl) FILTER (net_pnl > 0) / abs(sum(net_pnl) FILTER (net_pnl <= 0)), 4) AS profit_factor FROM trades"""


def _bd(df, by, extra=()):
    cols = ["total_trades", "win_count", "loss_count", "gross_profit", "gross_loss", "net_profit", "win_rate", "profit_factor"]
    df = df.select(*by, *extra, *cols)
    return rounded(rounded(df, ["gross_profit", "gross_loss", "net_profit"], 5), ["win_rate", "profit_factor"], 4)


@query("metrics_breakdown_session", b.with_sql("trades") + f" SELECT exit_session, entry_regime, {_BD} GROUP BY exit_session, entry_regime")
def metrics_breakdown_session(spark, d):
    by = ["exit_session", "entry_regime"]
    return _bd(metrics.breakdown(b.trades(spark, d), by), by)


@query("metrics_breakdown_cube", b.with_sql("trades") + f" SELECT exit_session, entry_regime, direction, grouping_id(exit_session, entry_regime, direction)::BIGINT AS grouping_id, {_BD} GROUP BY CUBE (exit_session, entry_regime, direction)")
def metrics_breakdown_cube(spark, d):
    by = ["exit_session", "entry_regime", "direction"]
    return _bd(metrics.breakdown(b.trades(spark, d), by, "cube"), by, ["grouping_id"])


@query("metrics_breakdown_rollup", b.with_sql("trades") + f""", trades2 AS (SELECT *, hour(exit_time) AS hour_utc, isodow(exit_time) - 1 AS day_of_week FROM trades)
 SELECT day_of_week, hour_utc, {_BD.replace('FROM trades', 'FROM trades2')} GROUP BY ROLLUP (day_of_week, hour_utc)""")
def metrics_breakdown_rollup(spark, d):
    t = b.trades(spark, d).withColumns({"hour_utc": F.hour("exit_time").cast("bigint"), "day_of_week": F.weekday("exit_time").cast("bigint")})
    by = ["day_of_week", "hour_utc"]
    return _bd(metrics.breakdown(t, by, "rollup"), by)


@query("path_last_closed_trade", _PATH + """ SELECT account, net_pnl, direction, exit_time FROM (SELECT *, max(seq) OVER (PARTITION BY account) AS top FROM tn) WHERE seq = top""")
def path_last_closed_trade(spark, d):
    return paths.last_closed_trade(b.trades(spark, d), ACC, ORDER, ["net_pnl", "direction", "exit_time"])


_POS = """WITH prev AS (SELECT o_custkey AS account, o_orderkey AS ticket FROM orders), cur AS (SELECT o_custkey AS account, o_orderkey AS ticket FROM orders WHERE o_orderstatus = 'O'),
 deals AS (SELECT o_custkey AS account, l_orderkey AS ticket, l_shipdate AS deal_time, l_partkey * 1000 + l_suppkey AS deal_id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS entry_type,
 l_extendedprice AS price, l_quantity AS volume, l_extendedprice * (l_discount - 0.04) AS profit, -l_tax AS swap, -l_quantity AS commission, l_linenumber - 1 AS reason_code, l_returnflag AS comment
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query("path_closed_positions", _POS + """, gone AS (SELECT * FROM prev ANTI JOIN cur USING (account, ticket)), x AS (SELECT d.*, row_number() OVER (PARTITION BY ticket ORDER BY entry_type DESC, deal_time DESC, deal_id DESC) AS last,
 first_value(price) OVER (PARTITION BY ticket ORDER BY deal_time, deal_id) AS open_price FROM deals d SEMI JOIN gone USING (account, ticket))
 SELECT account, ticket, open_price, price AS close_price, volume, round(profit + swap + commission, 6) AS net_profit, deal_time AS closed_at,
 CASE reason_code WHEN 4 THEN 'SL_HIT' WHEN 5 THEN 'TP_HIT' WHEN 0 THEN 'MANUAL_CLOSE' WHEN 3 THEN 'MARGIN_STOP_OUT' ELSE comment END AS close_reason FROM x WHERE last = 1""")
def path_closed_positions(spark, d):
    o, li = b.table(spark, d, "orders"), b.table(spark, d, "lineitem")
    prev = o.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("ticket"))
    cur = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("ticket"))
    deals = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("account"), F.col("l_orderkey").alias("ticket"), b.utc("l_shipdate").alias("deal_time"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("deal_id"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("entry_type"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("volume"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.04)).alias("profit"),
        (-F.col("l_tax")).alias("swap"), (-F.col("l_quantity")).alias("commission"), (F.col("l_linenumber") - 1).alias("reason_code"), F.col("l_returnflag").alias("comment"))
    return rounded(paths.closed_positions(prev, cur, deals), ["net_profit"], 6)


@query("path_owned_positions", "SELECT o_orderkey AS ticket FROM orders WHERE o_custkey % 10 = 3 OR o_orderpriority = '5-LOW'")
def path_owned_positions(spark, d):
    pos = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("ticket"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") % 10).alias("magic"))
    return paths.owned(pos, 3).select("ticket")


# ---- mandate

_DAY = "timezone('Europe/Prague', timezone('UTC', {}))::DATE"
_POINTS = _PATH + f""", dd AS (SELECT *, {_DAY.format('exit_time')} AS day FROM path), fl AS (SELECT *, max(day) OVER (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM dd),
 ds AS (SELECT *, last_value(CASE WHEN pm IS NULL OR day > pm THEN equity END IGNORE NULLS) OVER (PARTITION BY account ORDER BY seq ROWS UNBOUNDED PRECEDING) AS daily_start FROM fl),
 pts AS MATERIALIZED (SELECT *, CASE WHEN daily_start > 0 THEN (daily_start - equity) * 100 / daily_start ELSE 0 END AS daily_loss_pct, ({EQ0} - equity) * 100 / {EQ0} AS overall_dd_pct FROM ds),
 br AS MATERIALIZED (SELECT *, CASE WHEN daily_loss_pct >= 4.0 THEN 'MANDATE_DAILY_LOSS_BREACH' WHEN overall_dd_pct >= 8.0 THEN 'MANDATE_OVERALL_DD_BREACH' END AS breach FROM pts)"""


@query("mandate_trading_days", b.with_sql("trades") + f" SELECT account, count(DISTINCT {_DAY.format('entry_time')}) AS trading_days, count(DISTINCT {_DAY.format('entry_time')}) >= 5 AS enough_days FROM trades GROUP BY account")
def mandate_trading_days(spark, d):
    return mandate.min_trading_days(b.trades(spark, d), ACC, M)


@query("mandate_points", _POINTS + f" SELECT {_KEY}, day, round(daily_loss_pct, 8) AS daily_loss_pct, round(overall_dd_pct, 8) AS overall_dd_pct, breach FROM br", dates=('day',))
def mandate_points(spark, d):
    t = b.trades(spark, d)
    p = mandate.trade_points(t, ACC, ORDER, b.trade_chunk(t), EQ0, M)
    cols = ["daily_loss_pct", "overall_dd_pct"]
    return rounded(p.select(*_KEY.split(", "), "day", *cols, "breach"), cols, 8)


@query("mandate_first_breach", _POINTS + """, f AS (SELECT account, count(*) AS points, min(seq) FILTER (breach IS NOT NULL) AS s FROM br GROUP BY account)
 SELECT f.account, f.points, s IS NULL AS compliant, br.breach, round(CASE br.breach WHEN 'MANDATE_DAILY_LOSS_BREACH' THEN daily_loss_pct ELSE overall_dd_pct END, 8) AS breach_pct, br.day AS breach_day
 FROM f LEFT JOIN br ON br.account = f.account AND br.seq = f.s""", dates=('breach_day',))
def mandate_first_breach(spark, d):
    t = b.trades(spark, d)
    p = mandate.trade_points(t, ACC, ORDER, b.trade_chunk(t), EQ0, M)
    return rounded(mandate.first_breach(p, ACC, ORDER, M).drop("breach_reason"), ["breach_pct"], 8)


@query("mandate_trailing_breach", _POINTS.replace(f"({EQ0} - equity) * 100 / {EQ0} AS overall_dd_pct", "(peak_equity - equity) * 100 / peak_equity AS overall_dd_pct") + """, f AS (SELECT account, min(seq) FILTER (breach IS NOT NULL) AS s FROM br GROUP BY account)
 SELECT f.account, s IS NULL AS compliant, br.breach, br.day AS breach_day FROM f LEFT JOIN br ON br.account = f.account AND br.seq = f.s""", dates=('breach_day',))
def mandate_trailing_breach(spark, d):
    m = {**M, "drawdown_type": "trailing"}
    t = b.trades(spark, d)
    p = mandate.trade_points(t, ACC, ORDER, b.trade_chunk(t), EQ0, m)
    return mandate.first_breach(p, ACC, ORDER, m).select("account", "compliant", "breach", "breach_day")


@query("mandate_risk_cap", b.with_sql("trades") + f""", r AS (SELECT *, lots / 4.5 AS risk_pct, row_number() OVER (PARTITION BY account ORDER BY {b.TRADE_ORDER_SQL}) AS seq FROM trades)
 SELECT account, round(arg_min(risk_pct, seq) FILTER (risk_pct > 1.0), 6) AS first_risk_pct, count(*) FILTER (risk_pct > 1.0) AS offenders,
 CASE WHEN count(*) FILTER (risk_pct > 1.0) > 0 THEN 'TRADE_RISK' END AS breach FROM r GROUP BY account""")
def mandate_risk_cap(spark, d):
    t = b.trades(spark, d).withColumn("risk_pct", F.col("lots") / 4.5)
    return rounded(mandate.risk_cap(t, ACC, ORDER, M, configured_risk_pct=1.0), ["first_risk_pct"])


@query("mandate_curve_violations", b.with_sql("trades") + f""", c AS (SELECT account, CASE WHEN part_key % 50 = 0 THEN NULL WHEN part_key % 51 = 0 THEN 'nan'::DOUBLE ELSE price END AS equity,
 CASE WHEN line_no = 7 THEN NULL ELSE exit_time END AS ts, row_number() OVER (PARTITION BY account ORDER BY {b.TRADE_ORDER_SQL}) AS seq FROM trades)
 SELECT account, count(*) FILTER (equity IS NULL) AS missing_equity, count(*) FILTER (isnan(equity)) AS non_finite, count(*) FILTER (equity IS NOT NULL AND NOT isnan(equity) AND ts IS NULL) AS missing_ts,
 arg_min_null(equity, seq) > 0 AS positive_start FROM c GROUP BY account""")
def mandate_curve_violations(spark, d):
    pk = F.col("part_key")
    c = b.trades(spark, d).withColumn("equity", F.when(pk % 50 == 0, None).when(pk % 51 == 0, F.lit(float("nan"))).otherwise(F.col("price"))) \
        .withColumn("ts", F.when(F.col("line_no") != 7, F.col("exit_time")))
    return mandate.curve_violations(c, ACC, ORDER)


@query("mandate_breaker_status", _POINTS + f""", u AS (SELECT *, exit_time::DATE AS ud, max(exit_time::DATE) OVER (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS um FROM br),
 us AS (SELECT *, last_value(CASE WHEN um IS NULL OR ud > um THEN equity END IGNORE NULLS) OVER (PARTITION BY account ORDER BY seq ROWS UNBOUNDED PRECEDING) AS utc_start FROM u),
 tr AS (SELECT *, CASE WHEN utc_start > 0 AND (equity - utc_start) * 100 / utc_start <= -3.0 OR overall_dd_pct >= 6.0 OR breach IS NOT NULL THEN 1 ELSE 0 END AS t FROM us)
 SELECT account, count(*) AS points, min(exit_time) FILTER (t = 1) AS tripped_at, max(t) = 1 AS tripped FROM tr GROUP BY account""")
def mandate_breaker_status(spark, d):
    t = b.trades(spark, d)
    chunk = b.trade_chunk(t)
    p = paths.equity_path(t, ACC, ORDER, chunk, EQ0).withColumn("ts", F.col("exit_time"))
    s = mandate.breaker_status(p.select(*ACC, *ORDER, "ts", "equity"), ACC, ORDER, chunk, EQ0, M)
    return s.groupBy("account").agg(F.count(F.lit(1)).alias("points"), F.min(F.when(F.col("tripped"), F.col("ts"))).alias("tripped_at"),
                                    F.bool_or("tripped").alias("tripped"))


PERMUTATIONS = 500
_IDENT = "concat_ws('|', perm, concat_ws('|', {}))".format(", ".join(["epoch(exit_time)::BIGINT", "order_key", "line_no", "part_key"]))


@query("mandate_stress_test", b.with_sql("trades") + f""", k AS (SELECT t.*, perm, (('0x' || substr(md5('order|' || {_IDENT}), 1, 8))::BIGINT / 4294967296.0) AS place,
 net_pnl - (('0x' || substr(md5('slip|' || {_IDENT}), 1, 8))::BIGINT / 4294967296.0) * 1.5 * 10.0 * lots AS pnl FROM trades t, range(0, {PERMUTATIONS}) r(perm)),
 e AS (SELECT *, {_DAY.format('exit_time')} AS day, {EQ0} + sum(pnl) OVER w AS equity, max({_DAY.format('exit_time')}) OVER (PARTITION BY account, perm ORDER BY place, exit_time, order_key, line_no, part_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
 FROM k WINDOW w AS (PARTITION BY account, perm ORDER BY place, exit_time, order_key, line_no, part_key ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, last_value(CASE WHEN pm IS NULL OR day > pm THEN equity END IGNORE NULLS) OVER (PARTITION BY account, perm ORDER BY place, exit_time, order_key, line_no, part_key ROWS UNBOUNDED PRECEDING) AS d0 FROM e),
 v AS (SELECT account, perm, bool_or((CASE WHEN d0 > 0 THEN (d0 - equity) * 100 / d0 ELSE 0 END) >= 4.0 OR ({EQ0} - equity) * 100 / {EQ0} >= 8.0) AS hit FROM s GROUP BY ALL)
 SELECT account, round(count(*) FILTER (hit) * 100.0 / count(*), 4) AS breach_rate_pct FROM v GROUP BY account""")
def mandate_stress_test(spark, d):
    t = b.trades(spark, d).withColumn("exit_epoch", F.unix_seconds("exit_time"))
    out = mandate.stress_test(t, ACC, ["exit_epoch", "order_key", "line_no", "part_key"], M, EQ0, F.lit(10.0), PERMUTATIONS)
    return rounded(out.select("account", "breach_rate_pct"), ["breach_rate_pct"], 4)
