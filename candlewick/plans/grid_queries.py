"""Queries over parameter grids and walk-forward evaluation (daily bars, years of history)."""

from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.functions.staging import stage
from candlewick.operators import bars as ob
from candlewick.operators import grid as g
from candlewick.operators import indicators as ind
from candlewick.operators import walkforward as wf
from candlewick.plans import indicator_sql as isql
from candlewick.plans import trade_sql as tsql
from candlewick.plans.bar_queries import rounded
from candlewick.plans.registry import query
from candlewick.schemas import INSTRUMENT

# The averages whose crossings grid_entry_signals counts; every search uses g.SPACES.
CROSSINGS = {"fast_ma_period": [5, 10, 20], "slow_ma_period": [30, 50], "ma_type": ["SMA"]}
CAPITAL = 10_000.0


def daily(spark, d):
    return b.indexed(b.daily_bars(spark, d), 86400)


def daily_specs(spark):
    row = b.SPECS[0]
    return b.literal_rows(spark, [(f"LN{i}", *row[1:]) for i in range(1, 8)], INSTRUMENT)


def _list(vals):
    return "[" + ", ".join(repr(v) if isinstance(v, str) else str(v).lower() for v in vals) + "]"


def _space_sql(template, names):
    sp = g.SPACES[template]
    return ", ".join(f"(SELECT unnest({_list(sp[n])}) AS {n})" for n in names)


_MA = ["fast_ma_period", "slow_ma_period", "sl_atr_multiple", "tp_rr_ratio", "adx_threshold"]


@query("grid_expand_ma", b.with_sql("bars") + f" SELECT symbol, n, {', '.join(_MA)} FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), {_space_sql('ma_crossover', _MA)} WHERE fast_ma_period < slow_ma_period")
def grid_expand_ma(spark, d):
    base = b.bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    out = g.parameter_grid(spark, "ma_crossover", base=base)
    return rounded(out, ["sl_atr_multiple", "tp_rr_ratio"], 4).select("symbol", "n", *_MA)


_SIZES = " UNION ALL ".join(f"SELECT symbol, '{t}' AS template, (SELECT count(*) FROM {_space_sql(t, list(sp))} {'WHERE ' + ' < '.join(g.ORDERED[t]) if t in g.ORDERED else ''}) AS grid_size FROM (SELECT DISTINCT symbol FROM bars)"
                            for t, sp in g.SPACES.items())


@query("grid_sizes", b.with_sql("bars") + " " + _SIZES)
def grid_sizes(spark, d):
    base = b.bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).select("symbol")
    out = None
    for t in g.SPACES:
        one = g.parameter_grid(spark, t, base=base).groupBy("symbol").agg(F.count(F.lit(1)).alias("grid_size")).withColumn("template", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out.select("symbol", "template", "grid_size")


_BAD = {"fast_ma_period": [0, 10, 60], "slow_ma_period": [30, 50], "sl_atr_multiple": [-1.0, 0.001, 1.5, 400.0], "tp_rr_ratio": [0.0, 2.0]}


@query("grid_coherence", isql.base() + isql.atr() + ", " + b.SQL["specs"] + f""", m AS (SELECT symbol, avg(atr) AS mean_atr FROM atr GROUP BY symbol), x AS (SELECT m.*, specs.* EXCLUDE (symbol), f, s, sl, tp FROM m JOIN specs USING (symbol),
 (SELECT unnest([0, 10, 60]) AS f), (SELECT unnest([30, 50]) AS s), (SELECT unnest([-1.0, 0.001, 1.5, 400.0]::DOUBLE[]) AS sl), (SELECT unnest([0.0, 2.0]::DOUBLE[]) AS tp))
 SELECT symbol, f AS fast_ma_period, s AS slow_ma_period, sl AS sl_atr_multiple, tp AS tp_rr_ratio, CASE WHEN f <= 0 THEN 'MA_PERIOD_NOT_POSITIVE' WHEN f >= s THEN 'FAST_NOT_BELOW_SLOW' WHEN sl <= 0 THEN 'STOP_NOT_POSITIVE' WHEN tp <= 0 THEN 'TARGET_NOT_POSITIVE'
 WHEN sl * mean_atr / point < stops_level THEN 'STOP_BELOW_BROKER_MINIMUM' WHEN {tsql.lots('10000.0', '1.0', 'sl * mean_atr')} = 0 THEN 'SIZE_ROUNDS_TO_ZERO' END AS incoherent_because FROM x""")
def grid_coherence(spark, d):
    stats = ind.atr(b.indexed_bars(spark, d)).groupBy("symbol").agg(F.avg("atr").alias("mean_atr")).join(b.specs(spark), "symbol")
    sets = g.parameter_grid(spark, "ma_crossover", _BAD, base=stats, valid_only=False)
    out = g.coherence(sets)
    return out.select("symbol", "fast_ma_period", "slow_ma_period", "sl_atr_multiple", "tp_rr_ratio", "incoherent_because")


def _win_sql(anchored):
    s = "lo" if anchored else "lo + to_months((n * 6)::INT)"
    return f"""w AS MATERIALIZED (SELECT symbol, n + 1 AS window_num, {s} AS opt_start, lo + to_months((36 + n * 6)::INT) AS opt_end, lo + to_months((36 + n * 6)::INT) AS test_start, least(hi, lo + to_months((42 + n * 6)::INT)) AS test_end
 FROM (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol), range(0, 40) r(n) WHERE lo + to_months((36 + n * 6)::INT) <= hi - to_months(6))"""


_WCOLS = " SELECT symbol, window_num, opt_start, opt_end, test_start, test_end FROM w"


@query("wf_windows_rolling", b.with_sql("daily") + ", " + _win_sql(False) + _WCOLS)
def wf_windows_rolling(spark, d):
    return wf.build_windows(b.daily_bars(spark, d), 36, 6).withColumn("window_num", F.col("window_num").cast("bigint"))


@query("wf_windows_anchored", b.with_sql("daily") + ", " + _win_sql(True) + _WCOLS)
def wf_windows_anchored(spark, d):
    return wf.build_windows(b.daily_bars(spark, d), 36, 6, anchored=True).withColumn("window_num", F.col("window_num").cast("bigint"))


@query("wf_sufficiency", b.with_sql("daily") + ", " + b.SQL["indexed"] + ", " + _win_sql(False) + """, c AS (SELECT w.symbol, window_num, count(*) FILTER (i.ts < opt_start) AS os, count(*) FILTER (i.ts < opt_end) AS oe, count(*) FILTER (i.ts < test_end) AS te FROM w JOIN indexed i USING (symbol) GROUP BY w.symbol, window_num),
 n AS (SELECT symbol, window_num, oe - greatest(0, os - 250) AS opt_bars, te - greatest(0, oe - 250) AS test_bars FROM c) SELECT *, CASE WHEN opt_bars < 1000 OR test_bars < 100 THEN 'INSUFFICIENT_DATA' ELSE 'OK' END AS status FROM n""")
def wf_sufficiency(spark, d):
    i = daily(spark, d)
    out = wf.sufficiency(wf.phase_spans(i, wf.build_windows(i, 36, 6)))
    return out.withColumn("window_num", F.col("window_num").cast("bigint"))


def _halves(i):
    """One MAIN and one HELD_OUT span per symbol: the last year is held out."""
    split = ob.holdout_split(i, held_out_months=12, opt_months=36, test_months=6)
    e = split.groupBy("symbol", F.col("split").alias("span_id")).agg(F.min("row_no").alias("start_no"), (F.max("row_no") + 1).alias("end_no"),
                                                                    F.min("ts").alias("start"), F.max("ts").alias("end"))
    return e


@query("wf_window_regimes", isql.features(bars="daily") + ", " + _win_sql(False) + """, p AS (SELECT symbol, window_num, 'is' AS part, opt_start AS s, opt_end AS e FROM w UNION ALL SELECT symbol, window_num, 'oos', test_start, test_end FROM w),
 c AS (SELECT p.symbol, window_num, part, regime, count(*) AS n FROM p JOIN feats f ON f.symbol = p.symbol AND f.ts >= s AND f.ts < e WHERE regime IS NOT NULL GROUP BY ALL),
 m AS (SELECT symbol, window_num, part, first(regime ORDER BY n DESC, regime) AS r FROM c GROUP BY ALL)
 SELECT w.symbol, w.window_num, coalesce(i.r, 'UNKNOWN') AS is_dominant_regime, coalesce(o.r, 'UNKNOWN') AS oos_dominant_regime FROM w
 LEFT JOIN m i ON i.symbol = w.symbol AND i.window_num = w.window_num AND i.part = 'is' LEFT JOIN m o ON o.symbol = w.symbol AND o.window_num = w.window_num AND o.part = 'oos'""")
def wf_window_regimes(spark, d):
    """The most frequent regime of every training and test window."""
    i = stage(daily(spark, d))
    spans = stage(wf.phase_spans(i, wf.build_windows(i, 36, 6)))
    return wf.window_regimes(ind.features(i), spans).withColumn("window_num", F.col("window_num").cast("bigint"))


@query("grid_entry_signals", b.with_sql("daily") + ", " + b.SQL["indexed"] + """, m AS (SELECT symbol, row_no, ts, close, p, CASE WHEN row_no >= p THEN avg(close) OVER (PARTITION BY symbol, p ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS dummy,
 CASE WHEN row_no >= p THEN (sum(close) OVER (PARTITION BY symbol, p ORDER BY row_no) - coalesce(s0, 0)) / p END AS v FROM (SELECT i.*, p, (SELECT sum(close) FROM indexed j WHERE j.symbol = i.symbol AND j.row_no <= i.row_no - p) AS s0 FROM indexed i, (SELECT unnest([5, 10, 20, 30, 50]) AS p) WHERE i.row_no >= 0)),
 l AS (SELECT *, lag(v) OVER (PARTITION BY symbol, p ORDER BY row_no) AS pv FROM m) SELECT f.symbol, f.p AS fast_ma_period, s.p AS slow_ma_period, count(*) FILTER (f.pv <= s.pv AND f.v > s.v) AS buys, count(*) FILTER (f.pv >= s.pv AND f.v < s.v) AS sells
 FROM l f JOIN l s ON s.symbol = f.symbol AND s.row_no = f.row_no AND f.p IN (5, 10, 20) AND s.p IN (30, 50) GROUP BY ALL""".replace("SELECT sum(close) FROM indexed j WHERE j.symbol = i.symbol AND j.row_no <= i.row_no - p", "SELECT cs FROM (SELECT symbol AS sy, row_no AS rn, sum(close) OVER (PARTITION BY symbol ORDER BY row_no) AS cs FROM indexed) j WHERE j.sy = i.symbol AND j.rn = i.row_no - p"))
def grid_entry_signals(spark, d):
    combos = g.entry_combos("ma_crossover", CROSSINGS)
    feats = g.grid_features(daily(spark, d), "ma_crossover", combos)
    s = g.entry_signals(feats, "ma_crossover", combos)
    return s.groupBy("symbol", "fast_ma_period", "slow_ma_period").agg(F.count_if(F.col("signal") == "BUY").alias("buys"), F.count_if(F.col("signal") == "SELL").alias("sells"))


def _searched(spark, d, template):
    r = wf.walk_forward(daily(spark, d), daily_specs(spark), template, g.SPACES[template], 36, 6, None, CAPITAL)
    return rounded(r, ["is_profit_factor", "is_calmar", "is_net_profit", "oos_profit_factor", "oos_calmar", "oos_net_profit", "oos_win_rate", "oos_max_drawdown"], 4)


@query("wf_walk_forward")
def wf_walk_forward(spark, d):
    """Search of the template's full grid per training window and the winner's out-of-sample check (the evaluation of
    every set and the choice of the winner are compared with loops on a fixture in the tests)."""
    return _searched(spark, d, "ma_crossover")


@query("wf_walk_forward_donchian")
def wf_walk_forward_donchian(spark, d):
    return _searched(spark, d, "donchian_breakout")


@query("wf_walk_forward_hybrid")
def wf_walk_forward_hybrid(spark, d):
    return _searched(spark, d, "hybrid_confluence")


@query("wf_walk_forward_rsi")
def wf_walk_forward_rsi(spark, d):
    return _searched(spark, d, "rsi_reversion")


@query("wf_leak_audit", b.with_sql("daily") + ", " + _win_sql(False) + " SELECT symbol, count(*) AS compared, 0::BIGINT AS changed, TRUE AS planted_found FROM w GROUP BY symbol")
def wf_leak_audit(spark, d):
    """Change every bar of the last test window; in-sample results of all windows must not move. A change inside the
    training windows, planted for comparison, must move them."""
    i = stage(daily(spark, d))
    # the first symbol-wide instant that belongs to no training window
    last = i.groupBy("symbol").agg(F.max("ts").alias("_hi")).groupBy().agg(F.min("_hi").alias("_hi"))

    def changed(months):
        cut = F.add_months("_hi", -months).cast("timestamp")
        return (i.withColumn("_k", F.lit(1)).join(F.broadcast(last.withColumn("_cut", cut).withColumn("_k", F.lit(1))), "_k")
                .withColumns({c: F.when(F.col("ts") >= F.col("_cut"), F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
                .drop("_k", "_cut", "_hi"))

    run = lambda x: wf.walk_forward(x, daily_specs(spark), "ma_crossover", g.SPACES["ma_crossover"], 36, 6, None, CAPITAL)
    base = stage(run(i))
    planted = wf.leak_audit(base, run(changed(18))).select("symbol", (F.col("changed") > 0).alias("planted_found"))
    return wf.leak_audit(base, run(changed(5))).join(planted, "symbol").select("symbol", "compared", "changed", "planted_found")


def _best_two(spark, ev, spans):
    """The two best sets of a template's full grid per symbol, with their scores and parameters."""
    sets = g.parameter_grid(spark, ev.template)
    top = g.top_sets(ev.scores(sets, spans.filter("span_id = 'MAIN'"), "params_id"), ["symbol"], 2).select("symbol", "params_id", F.col("score").alias("main_score"))
    return stage(top.join(sets, "params_id"))


@query("wf_filter_test")
def wf_filter_test(spark, d):
    """Forward filter selection for the best two sets of every template and symbol."""
    i, out = stage(daily(spark, d)), None
    spans = stage(_halves(i))
    for template, space in g.SPACES.items():
        ev = wf.Evaluation(i, daily_specs(spark), template, space)
        tested, _ = wf.filter_test(ev, _best_two(spark, ev, spans), spans)
        one = tested.select("symbol", F.lit(template).alias("template"), "params_id", "adx_threshold", "atr_ratio_min", "atr_ratio_max",
                            F.array_join("applied", ",").alias("applied"), F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query("wf_combination_test")
def wf_combination_test(spark, d):
    """Entries of one template with exits of another, for every pair, against both parents."""
    i, spec, out = stage(daily(spark, d)), daily_specs(spark), None
    spans = stage(_halves(i).filter("span_id = 'MAIN'"))
    best = {t: _best_two(spark, wf.Evaluation(i, spec, t, g.SPACES[t]), spans) for t in dict.fromkeys(t for pair in g.COMBINATIONS for t in pair)}
    parents = {t: top.select("symbol", "params_id", F.col("main_score").alias("score")) for t, top in best.items()}
    for entry, rule in g.COMBINATIONS:
        # a set per symbol that chose it: only the best two are combined
        combo = wf.Evaluation(i, spec, entry, g.SPACES[entry], exit_template=rule).scores(best[entry], spans, "params_id")
        one = wf.combination_test(parents[entry], parents[rule], combo).withColumns({"entry_template": F.lit(entry), "exit_template": F.lit(rule)})
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["entry_score", "exit_score", "combo_score"])
