"""Walk-forward windows, in-sample search, out-of-sample check, filter and combination tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.staging import stage
from candlewick.operators import bars as ob
from candlewick.operators import grid as g
from candlewick.operators import indicators as ind

MIN_OPT_BARS, MIN_TEST_BARS = 1000, 100


def _months(n: Column) -> Column:
    return F.make_ym_interval(F.lit(0), n.cast("int"))


def build_windows(bars: DataFrame, opt_months: int, test_months: int, anchored: bool = False) -> DataFrame:
    """window_num, opt_start, opt_end, test_start, test_end per symbol; month offsets count from the first bar."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    upper = F.greatest(F.lit(0), F.ceil(F.months_between("_hi", "_lo") / test_months)).cast("int")
    w = span.withColumn("_n", F.explode(F.sequence(F.lit(0), upper)))
    cur = F.col("_lo") + _months(F.lit(opt_months) + F.col("_n") * test_months)
    w = w.withColumn("opt_end", cur).filter(F.col("opt_end") <= F.col("_hi") - _months(F.lit(test_months)))
    start = F.col("_lo") if anchored else F.col("_lo") + _months(F.col("_n") * test_months)
    end = F.col("_lo") + _months(F.lit(opt_months + test_months) + F.col("_n") * test_months)
    return w.select("symbol", (F.col("_n") + 1).alias("window_num"), start.alias("opt_start"), "opt_end", F.col("opt_end").alias("test_start"),
                    F.least(end, F.col("_hi")).alias("test_end"))


def phase_spans(indexed: DataFrame, windows: DataFrame) -> DataFrame:
    """Row-number spans of both phases: symbol, window_num, phase, span_id, start, end, start_no, end_no."""
    p = windows.select("symbol", "window_num", F.explode(F.array(
        F.struct(F.lit("OPT").alias("phase"), F.col("opt_start").alias("start"), F.col("opt_end").alias("end")),
        F.struct(F.lit("TEST").alias("phase"), F.col("test_start").alias("start"), F.col("test_end").alias("end")))).alias("_p")) \
        .select("symbol", "window_num", "_p.*").withColumn("span_id", F.concat_ws(":", "window_num", "phase"))
    edges = ob.window_edges(indexed, p.select("symbol", F.col("span_id").alias("window_id"), "start", "end"))
    return p.join(edges.withColumnRenamed("window_id", "span_id"), ["symbol", "span_id"])


def sufficiency(spans: DataFrame, warmup: int = 250, min_opt: int = MIN_OPT_BARS, min_test: int = MIN_TEST_BARS) -> DataFrame:
    """Bars per phase, warm-up included, and INSUFFICIENT_DATA where there are too few."""
    n = F.col("end_no") - F.greatest(F.lit(1), F.col("start_no") - warmup)
    c = spans.groupBy("symbol", "window_num").agg(*[F.max(F.when(F.col("phase") == ph, n)).alias(f"{ph.lower()}_bars") for ph in ("OPT", "TEST")])
    short = (F.col("opt_bars") < min_opt) | (F.col("test_bars") < min_test)
    return c.withColumn("status", F.when(short, "INSUFFICIENT_DATA").otherwise("OK"))


def window_regimes(feats: DataFrame, spans: DataFrame, block: int = 1024) -> DataFrame:
    """is_dominant_regime and oos_dominant_regime per symbol and window: the most frequent regime of each phase's bars, UNKNOWN without one.

    Bars and spans meet on (symbol, block of rows); labels are counted before anything is gathered.
    """
    cut = spans.select("symbol", "window_num", "phase", "start_no", "end_no").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_no") / block), F.floor(F.col("end_no") / block))))
    bars = feats.filter(F.col("regime").isNotNull()).select("symbol", "row_no", "regime").withColumn("_block", F.floor(F.col("row_no") / block))
    inside = bars.join(cut, ["symbol", "_block"]).filter((F.col("row_no") >= F.col("start_no")) & (F.col("row_no") < F.col("end_no")))
    found = ind.dominant_regime(inside, ["symbol", "window_num", "phase"])
    every = spans.select("symbol", "window_num", "phase").join(found, ["symbol", "window_num", "phase"], "left")
    of = lambda phase, name: F.coalesce(F.max(F.when(F.col("phase") == phase, F.col("dominant_regime"))), F.lit("UNKNOWN")).alias(name)
    return every.groupBy("symbol", "window_num").agg(of("OPT", "is_dominant_regime"), of("TEST", "oos_dominant_regime"))


def walk_forward(indexed: DataFrame, specs: DataFrame, template: str, space: dict, opt_months: int, test_months: int, mandate: dict | None = None,
                 capital: float = 10_000.0, anchored: bool = False, noise: bool = True, min_opt: int = MIN_OPT_BARS, min_test: int = MIN_TEST_BARS,
                 min_trades_opt: int = 10, min_trades_test: int = 10) -> DataFrame:
    """Every window of every symbol: best coherent set in-sample over the full grid, then that set out-of-sample."""
    spark = indexed.sparkSession
    indexed = stage(indexed)
    windows = build_windows(indexed, opt_months, test_months, anchored)
    spans = stage(phase_spans(indexed, windows))
    enough = sufficiency(spans, min_opt=min_opt, min_test=min_test)
    usable = spans.join(enough.filter("status = 'OK'").select("symbol", "window_num"), ["symbol", "window_num"], "left_semi")
    g.check_space(template, space)
    combos, exits = g.entry_combos(template, space), g.exit_combos(space, template)
    feats = stage(g.grid_features(indexed, template, combos, [e[4] for e in exits]))
    sets = g.with_axes(g.coherence(g.parameter_grid(spark, template, space)).filter("incoherent_because IS NULL").drop("incoherent_because"), template)
    out = stage(g.outcomes(g.entry_signals(feats, template, combos), feats, specs, template, exits, capital=capital, noise=noise, combos=combos))
    opt = usable.filter("phase = 'OPT'")
    scored = g.score_trades(g.pick_trades(out, feats, specs, template, sets, opt, capital=capital), opt, "params_id", capital, mandate, min_trades_opt, True)
    best = stage(g.best_per_span(scored).withColumn("window_num", F.split("span_id", ":")[0].cast("int")))
    test = usable.filter("phase = 'TEST'")
    # only the winner of a window is evaluated out of sample
    chosen = best.select("symbol", "params_id", F.concat_ws(":", "window_num", F.lit("TEST")).alias("span_id")).join(sets, "params_id")
    run = g.pick_trades(out, feats, specs, template, chosen, test, "params_id", capital)
    oos = g.score_trades(run, test, "params_id", capital, mandate, min_trades_test, False).withColumn("window_num", F.split("span_id", ":")[0].cast("int"))
    o = oos.select("symbol", "window_num", F.col("total_trades").alias("oos_trades"), F.col("profit_factor").alias("oos_profit_factor"), F.col("calmar_ratio").alias("oos_calmar"),
                   F.col("net_profit").alias("oos_net_profit"), F.col("win_rate").alias("oos_win_rate"), F.col("max_drawdown_pct").alias("oos_max_drawdown"),
                   F.col("max_consecutive_losses").alias("oos_max_consec_losses"), F.col("score").alias("oos_composite_score"),
                   *([F.col("compliant").alias("oos_mandate_compliant"), F.col("breach_reason").alias("oos_mandate_breach_reason")] if mandate else []))
    b = best.select("symbol", "window_num", "params_id", F.col("total_trades").alias("is_trades"), F.col("profit_factor").alias("is_profit_factor"), F.col("calmar_ratio").alias("is_calmar"),
                    F.col("net_profit").alias("is_net_profit"), F.col("score").alias("is_composite_score"))
    r = windows.join(enough, ["symbol", "window_num"], "left").join(window_regimes(feats, spans), ["symbol", "window_num"], "left").join(b, ["symbol", "window_num"], "left").join(o, ["symbol", "window_num"], "left")
    r = r.withColumn("status", F.when(F.col("status") != "OK", F.col("status")).when(F.col("params_id").isNull(), "INSUFFICIENT_TRADES").otherwise("OK"))
    zero = ["oos_trades", "oos_profit_factor", "oos_calmar", "oos_net_profit", "oos_win_rate", "oos_max_drawdown", "oos_max_consec_losses", "oos_composite_score"]
    return r.fillna(0, zero)


class Evaluation:
    """Factored outcomes of one template on one bar table, shared by filter and combination tests."""

    def __init__(self, indexed: DataFrame, specs: DataFrame, template: str, space: dict, exit_template: str | None = None,
                 capital: float = 10_000.0, noise: bool = True):
        g.check_space(template, space)
        self.template, self.exit_template, self.specs, self.capital = template, exit_template, specs, capital
        self.axes = g.ENTRY_AXES[template]
        combos, exits = g.entry_combos(template, space), g.exit_combos(space, template, exit_template)
        self.feats = stage(g.grid_features(stage(indexed), template, combos, [e[4] for e in exits]))
        self.out = stage(g.outcomes(g.entry_signals(self.feats, template, combos), self.feats, specs, template, exits, exit_template, capital, noise, combos=combos))

    def trades(self, sets: DataFrame, spans: DataFrame, key: str) -> DataFrame:
        return g.pick_trades(self.out, self.feats, self.specs, self.template, sets, spans, key, self.capital, exit_template=self.exit_template)

    def scores(self, sets: DataFrame, spans: DataFrame, key: str, min_trades: int = 10) -> DataFrame:
        """Quick score per (symbol, span, set) that traded at all."""
        return g.score_trades(self.trades(sets, spans, key), spans, key, self.capital, None, min_trades, False).select("symbol", "span_id", key, "score")


_SETTING_COLS = {"allowed_sessions": "array<string>", "adx_threshold": "double", "atr_ratio_min": "double", "atr_ratio_max": "double"}


def filter_test(ev: Evaluation, candidates: DataFrame, spans: DataFrame, rates: DataFrame | None = None, max_filters: int = 2,
                threshold: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Forward selection of filters for every candidate (symbol, params_id, axes, stop, target, adx_threshold).

    ``spans`` has one MAIN and one HELD_OUT row per symbol. Each of the three filters is one round for
    all candidates and symbols together: best setting in-sample, kept if it beats the current
    held-out score by ``threshold``. ``rates`` (filter_name, template, improvement_rate) skips filters that
    rarely helped this template. Returns (candidates with filters and score, filter results).
    """
    cur = candidates
    for c, t in _SETTING_COLS.items():
        cur = cur.withColumn(c, F.col(c).cast(t) if c in cur.columns else F.lit(None).cast(t))
    cur = cur.withColumn("adx_threshold", F.coalesce("adx_threshold", F.lit(0.0))).withColumn("n_filters", F.lit(0)).withColumn("applied", F.array().cast("array<string>"))
    main, held = spans.filter("span_id = 'MAIN'"), spans.filter("span_id = 'HELD_OUT'")

    def evaluate(rows: DataFrame, span: DataFrame, out: str) -> DataFrame:
        rows = rows.withColumn("set_id", F.concat_ws("|", "params_id", F.coalesce("setting", F.lit("-"))))
        s = g.score_trades(ev.trades(rows, span, "set_id"), span, "set_id", ev.capital, None, 10, False).select("symbol", "set_id", F.col("score").alias(out))
        return rows.join(s, ["symbol", "set_id"], "left").fillna(0.0, [out]).drop("set_id")

    cur = stage(evaluate(cur.withColumn("setting", F.lit(None).cast("string")), held, "score").drop("setting"))
    log = None
    for name, settings in g.FILTER_SETTINGS.items():
        null = lambda t: F.lit(None).cast(t)
        opts = F.array(*[F.struct(
            F.lit(f"{name}{i}").alias("setting"),
            (F.array(*[F.lit(v) for v in o["allowed_sessions"]]) if "allowed_sessions" in o else null("array<string>")).alias("s"),
            (F.lit(float(o["adx_min_threshold"])) if "adx_min_threshold" in o else null("double")).alias("a"),
            F.lit(o.get("atr_ratio_min")).cast("double").alias("lo"), F.lit(o.get("atr_ratio_max")).cast("double").alias("hi"))
            for i, o in enumerate(settings)])
        live = cur.filter(F.col("n_filters") < max_filters)
        if rates is not None:
            weak = rates.filter((F.col("filter_name") == name) & (F.col("improvement_rate") < 0.20))
            if "template" in rates.columns:  # what failed for another template says nothing here
                weak = weak.filter(F.col("template") == ev.template)
            weak = weak.select("filter_name").distinct()
            # at most one row: the distinct name
            live = live.withColumn("filter_name", F.lit(name)).join(F.broadcast(weak), "filter_name", "left_anti").drop("filter_name")
        tried = live.withColumn("_o", F.explode(opts))
        tried = (tried.withColumn("setting", F.col("_o.setting")).withColumn("allowed_sessions", F.coalesce("_o.s", "allowed_sessions"))
                 .withColumn("adx_threshold", F.coalesce("_o.a", "adx_threshold")).withColumn("atr_ratio_min", F.coalesce("_o.lo", "atr_ratio_min"))
                 .withColumn("atr_ratio_max", F.coalesce("_o.hi", "atr_ratio_max")).drop("_o"))
        rank = Window.partitionBy("symbol", "params_id").orderBy(F.desc("is_score"), "setting")
        best = stage(evaluate(stage(tried), main, "is_score").withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r"))
        test = stage(evaluate(best, held, "new_score").withColumn("improved", F.col("new_score") > F.col("score") * (1 + threshold)))
        entry = test.select("symbol", "params_id", F.lit(name).alias("filter_name"), "setting", "improved", (F.col("new_score") - F.col("score")).alias("delta"))
        log = entry if log is None else log.unionByName(entry)
        kept = test.filter("improved").withColumn("score", F.col("new_score")).withColumn("n_filters", F.col("n_filters") + 1).withColumn(
            "applied", F.array_append("applied", F.col("setting"))).select(*cur.columns)
        cur = stage(cur.join(kept.select("symbol", "params_id"), ["symbol", "params_id"], "left_anti").unionByName(kept))
    return cur, log


def combination_test(entry_top: DataFrame, exit_top: DataFrame, combo_scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Combinations of the top entry and exit candidates that beat the better parent by ``threshold``.

    ``entry_top`` / ``exit_top``: symbol, params_id, score (two per symbol). ``combo_scores``: symbol,
    params_id (of the entry candidate), score of its entries with the other template's exits.
    """
    pairs = (entry_top.select("symbol", F.col("params_id").alias("entry_id"), F.col("score").alias("entry_score"))
             .join(exit_top.select("symbol", F.col("params_id").alias("exit_id"), F.col("score").alias("exit_score")), "symbol"))
    c = pairs.join(combo_scores.select("symbol", F.col("params_id").alias("entry_id"), F.col("score").alias("combo_score")), ["symbol", "entry_id"])
    return c.withColumn("beats_parents", F.col("combo_score") > F.greatest("entry_score", "exit_score") * (1 + threshold))


def leak_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """In-sample results compared and changed between two runs, per symbol (none changes unless out-of-sample data leaks)."""
    cols = ["symbol", "window_num", "params_id", "is_trades", "is_composite_score"]
    return ind.change_audit(before.select(*cols), after.select(*cols))
