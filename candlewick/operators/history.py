"""Experiment-history analytics over append-only trial, run and filter tables.

"Last N per group" filters ``row_number() <= N``: Spark keeps the N best rows per group on the map
side before the shuffle, so a hot group sends N rows per task and not its whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parameters that do not belong to a trial's identity.
IGNORED = ("pip_size", "risk_per_trade_pct", "warmup_candles")


def clean_parameters(params: Column) -> Column:
    return F.map_filter(params, lambda k, _: ~k.isin(*IGNORED))


def parameter_text(params: Column) -> Column:
    """Canonical text of a parameter map."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str = "_back") -> DataFrame:
    """The latest ``n`` rows per key; ``rank`` counts back from the newest."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def append_trials(trials: DataFrame, path: str) -> None:
    trials.withColumn("parameters", clean_parameters(F.col("parameters"))).write.mode("append").partitionBy("template").parquet(path)


def top_candidates(trials: DataFrame, k: int = 5, target_regime: Column | str = "UNKNOWN", timeframe: str | None = None,
                   results: DataFrame | None = None) -> DataFrame:
    """Best ``k`` distinct parameter sets per (template, symbol), matching regime first.

    ``results`` are stored candidates without a regime; they only ever count as other regimes.
    """
    cols = ["template", "symbol", "timeframe", "composite_score", "parameters", "regime_match"]
    match = F.coalesce(F.col("in_sample_regime"), F.lit("UNKNOWN")) == target_regime
    pool = trials.filter(F.coalesce("is_coherent", F.lit(True))).withColumn("regime_match", match).select(*cols)
    if results is not None:
        pool = pool.unionByName(results.withColumn("regime_match", F.lit(False)).select(*cols))
    pool = pool.filter(F.col("composite_score") > 0)
    if timeframe is not None:
        pool = pool.filter(F.col("timeframe").isNull() | F.col("timeframe").isin("unknown", timeframe))
    best = (pool.withColumn("params_text", parameter_text(F.col("parameters"))).groupBy("template", "symbol", "params_text")
            .agg(F.max(F.struct(F.col("regime_match").cast("int").alias("m"), F.col("composite_score").alias("s"))).alias("_b")))
    w = Window.partitionBy("template", "symbol").orderBy(F.desc("_b.m"), F.desc("_b.s"), "params_text")
    return (best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
            .select("template", "symbol", "place", "params_text", (F.col("_b.m") == 1).alias("regime_match"), F.col("_b.s").alias("composite_score")))


def region_key(fast: Column, slow: Column, sl: Column, tp: Column, adx: Column) -> Column:
    """Coarse parameter region of a moving-average crossover, keys in alphabetical order."""
    parts = [
        ("adx_threshold", F.when(adx == 0, "DISABLED").when(adx <= 15, "WEAK").when(adx <= 20, "MODERATE").otherwise("STRONG")),
        ("fast_ma_period", F.when(fast <= 15, "SHORT").when(fast <= 30, "MEDIUM").otherwise("LONG")),
        ("sl_atr_multiple", F.when(sl <= 1.5, "TIGHT").otherwise("WIDE")),
        ("slow_ma_period", F.when(slow <= 60, "MEDIUM").when(slow <= 120, "LONG").otherwise("EXTRA_LONG")),
        ("tp_rr_ratio", F.when(tp <= 2.0, "LOW").otherwise("HIGH"))]
    return F.concat_ws("|", *[F.concat(F.lit(n + "="), v) for n, v in parts])


def bucketed(trials: DataFrame) -> DataFrame:
    """Add the region of every trial; templates without buckets get an empty region."""
    p = lambda name, default: F.coalesce(F.try_element_at("parameters", F.lit(name)).cast("double"), F.lit(float(default)))
    key = region_key(p("fast_ma_period", 10), p("slow_ma_period", 50), p("sl_atr_multiple", 1.5), p("tp_rr_ratio", 2.0), p("adx_threshold", 0))
    return trials.withColumn("region", F.when(F.col("template") == "ma_crossover", key).otherwise(F.lit("")))


def region_statistics(trials: DataFrame, min_samples: int = 30) -> DataFrame:
    """Count, mean and best score per region of templates with enough samples (negative scores only count as samples)."""
    s = F.col("composite_score")
    per = bucketed(trials).groupBy("template", "symbol", "region").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(s >= 0).alias("count"), F.avg(F.when(s >= 0, s)).alias("mean_score"),
        F.max(F.when(s >= 0, s)).alias("max_score"))
    total = F.sum("_all").over(Window.partitionBy("template", "symbol"))
    return (per.withColumn("total_samples", total).filter((F.col("total_samples") >= min_samples) & (F.col("count") > 0)).drop("_all"))


def template_performance(trials: DataFrame, order: Sequence[str], promoted: Column) -> DataFrame:
    """Tested, promoted, best ever, last dates and trend (last three scores against the three before)."""
    keys = ["template", "symbol"]
    base = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("times_tested"), F.count_if(promoted).alias("times_promoted"),
        F.greatest(F.lit(0.0), F.max("composite_score")).alias("best_score_ever"), F.max("ts").alias("last_tested"),
        F.max(F.when(promoted, F.col("ts"))).alias("last_promoted"))
    six = last_n(trials, keys, order, 6).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("_back") <= 3, F.col("composite_score"))).alias("_new"),
        F.avg(F.when(F.col("_back") > 3, F.col("composite_score"))).alias("_old"))
    trend = (F.when(F.col("_n") < 6, "FLAT").when(F.col("_new") > F.col("_old") * 1.10, "UP")
             .when(F.col("_new") < F.col("_old") * 0.90, "DOWN").otherwise("FLAT"))
    return base.join(six, keys).withColumn("trend", trend).drop("_n", "_new", "_old")


def parameter_insights(trials: DataFrame, order: Sequence[str]) -> DataFrame:
    """Mean of the last ten scores per parameter value, the best value and the confidence."""
    long = trials.select("template", "symbol", "composite_score", *order, F.explode("parameters").alias("parameter", "value"))
    keys = ["template", "symbol", "parameter"]
    per = last_n(long, [*keys, "value"], order, 10).groupBy(*keys, "value").agg(
        F.avg("composite_score").alias("mean_score"), F.count(F.lit(1)).alias("tests"))
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(F.desc("mean_score"), "value"))
    n = F.sum("tests").over(w)
    return (per.withColumn("place", place).withColumn("total_tests", n)
            .withColumn("best_value", F.first("value").over(w.orderBy("place")))
            .withColumn("confidence", F.when(F.col("total_tests") >= 15, "HIGH").when(F.col("total_tests") >= 5, "MEDIUM").otherwise("LOW")))


def good_values(insights: DataFrame, top_n: int = 3) -> DataFrame:
    return insights.filter((F.col("confidence") != "LOW") & (F.col("place") <= top_n))


def filter_effectiveness(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Applied, improved, rate (NULL below five trials) and mean of the last 20 deltas per filter and template."""
    keys = ["filter_name", "template"]
    base = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("applied_count"), F.count_if("improved").alias("improved_count"))
    recent = last_n(results, keys, order, 20).groupBy(*keys).agg(F.avg("delta").alias("avg_improvement"))
    return base.join(recent, keys).withColumn(
        "improvement_rate", F.when(F.col("applied_count") >= 5, F.col("improved_count") / F.col("applied_count")))


def regime_patterns(results: DataFrame, order: Sequence[str]) -> DataFrame:
    return last_n(results, ["regime", "template"], order, 20).groupBy("regime", "template").agg(
        F.avg("pf").alias("avg_pf"), F.avg("win_rate").alias("avg_win_rate"))


def best_template(patterns: DataFrame) -> DataFrame:
    """Template with the highest mean profit factor per regime (lowest name on ties)."""
    return patterns.groupBy("regime").agg(F.min_by("template", F.struct(-F.col("avg_pf"), "template")).alias("template"))


def run_trend(runs: DataFrame, metrics: Sequence[str], order: Sequence[str], n: int = 5, keep: int = 50) -> DataFrame:
    """The last ``n`` values of each metric among the ``keep`` newest runs, long form (a top-k report)."""
    kept = runs.orderBy(*[F.desc(c) for c in order]).limit(keep)
    long = kept.select(*order, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    return last_n(long.filter(F.col("value").isNotNull()), ["metric"], order, n, rank="back")


def store_counts(trials: DataFrame, approximate: bool = False) -> DataFrame:
    """Runs, candidates and templates tracked; sketches instead of exact sets on request."""
    n = F.approx_count_distinct if approximate else F.countDistinct
    return trials.agg(n("run_id").alias("total_runs"), n("config_hash").alias("candidates_tested"), n(F.concat_ws("_", "template", "symbol")).alias("templates_tracked"))


# ---- hashes and memory lookups -----------------------------------------------------------------

def _json_map(m: Column, spaced: bool) -> Column:
    colon, comma = (": ", ", ") if spaced else (":", ",")
    body = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e["key"], F.lit(f'"{colon}"'), e["value"], F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(body, comma), F.lit("}"))


def config_hash(template: Column, symbol: Column, timeframe: Column, parameters: Column, filters: Column) -> Column:
    """First 16 hex digits of SHA-256 over sorted JSON with string values."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.concat(F.lit('{"filters": '), _json_map(filters, True), F.lit(', "parameters": '), _json_map(parameters, True), F.lit(', "symbol": '),
                    q(symbol), F.lit(', "template": '), q(template), F.lit(', "timeframe": '), q(timeframe), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)


def dna_hash(parameters_json: Column, filters_json: Column) -> Column:
    """SHA-256 over canonical JSON; inputs are objects already in canonical form (sorted, no blanks)."""
    return F.sha2(F.concat(F.lit('{"filters":'), filters_json, F.lit(',"parameters":'), parameters_json, F.lit("}")), 256)


def hash_mismatches(strategies: DataFrame) -> DataFrame:
    """Stored strategies whose dna_hash is missing or wrong."""
    expected = dna_hash(F.col("parameters_json"), F.col("filters_json"))
    return strategies.withColumn("expected_hash", expected).filter(F.col("dna_hash").isNull() | (F.col("dna_hash") != F.col("expected_hash")))


def data_hash(ranges: DataFrame) -> DataFrame:
    """16 hex digits per symbol and timeframe over the available range (start, end, count)."""
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    text = F.concat_ws("_", "symbol", "timeframe", iso("start"), iso("end"), F.col("count").cast("string"))
    return ranges.withColumn("data_hash", F.substring(F.sha2(text, 256), 1, 16))


def untested(candidates: DataFrame, tested: DataFrame) -> DataFrame:
    """Candidates whose (config_hash, data_hash) was not evaluated before."""
    return candidates.join(tested.select("config_hash", "data_hash"), ["config_hash", "data_hash"], "left_anti")


def with_cached_score(candidates: DataFrame, tested: DataFrame) -> DataFrame:
    known = tested.groupBy("config_hash", "data_hash").agg(F.max("composite_score").alias("cached_score"))
    return candidates.join(known, ["config_hash", "data_hash"], "left")
