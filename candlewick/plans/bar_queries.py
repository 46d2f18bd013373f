"""Queries over bars: sources, resampling, quality, calendar."""

from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.functions import calendar
from candlewick.functions.staging import fresh_folder, stage
from candlewick.operators import bars as ob
from candlewick.operators import quality
from candlewick.plans.registry import query
from candlewick.sources import bars as sb

START, END = "2024-01-08 00:00:00", "2024-01-21 12:00:00"
# Fixed export faults planted by event id: unreadable date, zero price, high below low.
_LINE_SQL = """lines AS (SELECT event_type AS symbol, event_id AS line_no,
  CASE WHEN event_id % 97 = 0 THEN '2024.13.77' ELSE strftime(ts, '%Y.%m.%d') END || ' ' ||
  strftime(ts, '%H:%M') || ':00 ' || CASE WHEN event_id % 89 = 0 THEN '0.00' ELSE printf('%.2f', value) END || ' ' ||
  printf('%.2f', value + 1) || ' ' || CASE WHEN event_id % 83 = 0 THEN printf('%.2f', value + 2)
  ELSE printf('%.3f', value / 2) END || ' ' || printf('%.2f', value) || ' ' || (user_id % 7) || ' 0 ' || (user_id % 20) AS line,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE date_trunc('minute', ts)::TIMESTAMP END AS ts,
  CASE WHEN event_id % 89 = 0 THEN 0.0::DOUBLE ELSE printf('%.2f', value)::DOUBLE END AS open,
  printf('%.2f', value + 1)::DOUBLE AS high,
  CASE WHEN event_id % 83 = 0 THEN printf('%.2f', value + 2)::DOUBLE ELSE printf('%.3f', value / 2)::DOUBLE END AS low,
  printf('%.2f', value)::DOUBLE AS close, (user_id % 7)::DOUBLE AS volume, (user_id % 20)::DOUBLE AS spread FROM events)"""
_CLEAN_SQL = """once AS (SELECT symbol, ts, count(*) AS n, arg_min(open, line_no) AS open, arg_min(high, line_no) AS high,
  arg_min(low, line_no) AS low, arg_min(close, line_no) AS close, arg_min(volume, line_no) AS volume,
  arg_min(spread, line_no) AS spread FROM lines WHERE ts IS NOT NULL GROUP BY symbol, ts),
 clean AS (SELECT * FROM once WHERE NOT (high < low OR open <= 0 OR close <= 0 OR high <= 0 OR low <= 0))"""
_MULTI_SQL = """built AS (SELECT symbol, timeframe, time_bucket(step, ts)::TIMESTAMP AS ts, arg_min(open, ts) AS open,
  max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, avg(spread) AS spread
  FROM clean, (VALUES ('M15', INTERVAL 15 MINUTE), ('H1', INTERVAL 1 HOUR), ('H4', INTERVAL 4 HOUR)) r(timeframe, step)
  WHERE isodow(time_bucket(step, ts)) <= 5 GROUP BY ALL)"""


def export_lines(spark, d):
    """Minute-export text built from the events, with planted faults."""
    e = b.table(spark, d, "events")
    fmt = lambda c: F.format_string("%.2f", c)
    v, i = F.col("value"), F.col("event_id")
    return stage(e.select(F.col("event_type").alias("symbol"), i.alias("line_no"), F.concat(
        F.when(i % 97 == 0, "2024.13.77").otherwise(F.date_format("ts", "yyyy.MM.dd")), F.lit(" "),
        F.date_format("ts", "HH:mm"), F.lit(":00 "), F.when(i % 89 == 0, "0.00").otherwise(fmt(v)), F.lit(" "),
        fmt(v + 1), F.lit(" "), F.when(i % 83 == 0, fmt(v + 2)).otherwise(F.format_string("%.3f", v / 2)), F.lit(" "), fmt(v), F.lit(" "),
        F.col("user_id") % 7, F.lit(" 0 "), F.col("user_id") % 20).alias("line")))


def nearest(x, digits):
    """A double rounded as the SQL does: scaled, rounded half away from zero, scaled back. ``F.round`` rounds the shortest decimal form instead."""
    scale = float(10 ** digits)
    return F.round(x * scale, 0) / scale


def rounded(df, cols, digits=6):
    kinds = dict(df.dtypes)
    return df.withColumns({c: nearest(F.col(c), digits) if kinds[c] == "double" else F.round(c, digits) for c in cols})


@query("bars_from_ticks", b.with_sql("bars") + """ SELECT symbol, timeframe, ts, open, high, low, close, volume,
 round(spread, 6) AS spread FROM bars""")
def bars_from_ticks(spark, d):
    return rounded(b.bars(spark, d), ["spread"])


@query("bars_written", b.with_sql("bars") + """ SELECT symbol, timeframe, ts, open, high, low, close, volume,
 round(spread, 6) AS spread FROM bars""")
def bars_written(spark, d):
    """Bars as partitioned files, read back."""
    folder = fresh_folder(spark)
    sb.write_bars(b.bars(spark, d), folder)
    return rounded(sb.read_bars(spark, folder), ["spread"]).select("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "spread")


@query("bars_slice", b.with_sql("bars") + f""" SELECT symbol, ts, open, high, low, close FROM bars
 WHERE symbol = 'click' AND ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'""")
def bars_slice(spark, d):
    return sb.slice_bars(b.bars(spark, d), "click", "H1", START, END).select("symbol", "ts", "open", "high", "low", "close")


@query("bars_slice_warmup", b.with_sql("indexed") + f""", f AS (SELECT symbol, coalesce(min(CASE WHEN ts >= TIMESTAMP '{START}'
 THEN row_no END), max(row_no) + 1) AS first_no FROM indexed GROUP BY symbol)
 SELECT i.symbol, i.ts, i.close, i.row_no, i.row_no < first_no AS is_warmup FROM indexed i JOIN f USING (symbol)
 WHERE i.row_no >= first_no - 50 AND i.ts <= TIMESTAMP '{END}'""")
def bars_slice_warmup(spark, d):
    return sb.slice_with_warmup(b.indexed_bars(spark, d), START, END, warmup=50).select(
        "symbol", "ts", "close", "row_no", "is_warmup")


@query("bars_available_range", b.with_sql("bars") + """ SELECT symbol, timeframe, min(ts) AS start, max(ts) AS "end",
 count(*) AS count FROM bars GROUP BY ALL""")
def bars_available_range(spark, d):
    return sb.available_range(b.bars(spark, d))


@query("export_clean_minutes", f"WITH {_LINE_SQL}, {_CLEAN_SQL} SELECT symbol, ts, open, high, low, close, volume, spread FROM clean")
def export_clean_minutes(spark, d):
    lines = export_lines(spark, d)
    return sb.load_minute_export(lines)


@query("export_parse_report", f"""WITH {_LINE_SQL}, {_CLEAN_SQL} SELECT l.symbol, count(*) AS raw_rows,
 count(*) FILTER (l.ts IS NULL) AS bad_timestamps,
 (SELECT sum(n - 1)::BIGINT FROM once o WHERE o.symbol = l.symbol) AS duplicates,
 (SELECT count(*) FROM once o WHERE o.symbol = l.symbol) - (SELECT count(*) FROM clean c WHERE c.symbol = l.symbol) AS invalid_ohlc,
 (SELECT count(*) FROM clean c WHERE c.symbol = l.symbol) AS clean_rows FROM lines l GROUP BY l.symbol""")
def export_parse_report(spark, d):
    return sb.parse_report(sb.parse_minute_export(export_lines(spark, d)))


@query("export_build_history", f"WITH {_LINE_SQL}, {_CLEAN_SQL}, {_MULTI_SQL} SELECT symbol, timeframe, ts, open, high, low, "
       "close, volume, round(spread, 6) AS spread FROM built")
def export_build_history(spark, d):
    return rounded(sb.build_history(export_lines(spark, d)), ["spread"])


@query("export_build_summary", f"""WITH {_LINE_SQL}, {_CLEAN_SQL}, {_MULTI_SQL} SELECT symbol, timeframe, count(*) AS candles,
 min(ts)::DATE AS start, max(ts)::DATE AS "end", 'OK' AS status FROM built GROUP BY ALL""", dates=('start', 'end'))
def export_build_summary(spark, d):
    return sb.build_summary(export_lines(spark, d))


@query("bars_resample_h4", b.with_sql("bars") + """ SELECT symbol, 'H4' AS timeframe, time_bucket(INTERVAL 4 HOUR, ts)::TIMESTAMP AS ts,
 arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume,
 round(avg(spread), 6) AS spread FROM bars WHERE isodow(time_bucket(INTERVAL 4 HOUR, ts)) <= 5 GROUP BY ALL""")
def bars_resample_h4(spark, d):
    return rounded(ob.resample(b.bars(spark, d), "H4"), ["spread"])


@query("bars_drop_weekends", b.with_sql("bars") + " SELECT symbol, ts, close FROM bars WHERE isodow(ts) <= 5")
def bars_drop_weekends(spark, d):
    return b.bars(spark, d).filter(ob.is_weekday(F.col("ts"))).select("symbol", "ts", "close")


def history_and_live(spark, d):
    """Ticks of ids 0-8 (mod 10) are history, of 7-9 live, so both know ids 7 and 8."""
    t = b.ticks(spark, d)
    m = F.col("seq") % 10
    return ob.ticks_to_bars(t.filter(m <= 8), "H1"), ob.ticks_to_bars(t.filter(m >= 7), "H1")


_SIDE = """SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(price, ts) AS open, max(price) AS high,
 min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume FROM ticks WHERE {} GROUP BY symbol, date_trunc('hour', ts)"""
_SIDES = b.with_sql("ticks") + f", h AS ({_SIDE.format('seq % 10 <= 8')}), l AS ({_SIDE.format('seq % 10 >= 7')})"


@query("bars_merge_live_wins", _SIDES + """ SELECT symbol, 'H1' AS timeframe, ts, open, high, low, close, volume FROM l UNION ALL
 SELECT symbol, 'H1', ts, open, high, low, close, volume FROM h WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.symbol = h.symbol AND l.ts = h.ts)""")
def bars_merge_live_wins(spark, d):
    return ob.merge_history_and_live(*history_and_live(spark, d))


@query("bars_price_contradictions", _SIDES + """ SELECT symbol, 'H1' AS timeframe, count(*) AS overlap,
 round(max(abs(h.close - l.close)), 6) AS max_close_diff, max(abs(h.close - l.close)) > 0.001 AS contradiction
 FROM h JOIN l USING (symbol, ts) GROUP BY symbol""")
def bars_price_contradictions(spark, d):
    return rounded(ob.price_contradictions(*history_and_live(spark, d)), ["max_close_diff"])


@query("bars_integrity", b.with_sql("bars") + """ SELECT symbol, timeframe, count(*) AS rows, count(*) - count(open) AS bad_open,
 count(*) - count(high) AS bad_high, count(*) - count(low) AS bad_low, count(*) - count(close) AS bad_close,
 count(*) - count(volume) AS bad_volume FROM bars GROUP BY ALL""")
def bars_integrity(spark, d):
    return ob.integrity(b.bars(spark, d))


def week_windows(bars):
    """Calendar weeks touched by each symbol, as slicing windows."""
    w = F.date_trunc("week", "ts").cast("timestamp")
    return (bars.groupBy("symbol", w.alias("start")).agg(F.lit(1).alias("_one"))
            .select("symbol", F.unix_seconds("start").alias("window_id"), "start",
                    (F.col("start") + F.expr("INTERVAL 7 DAYS")).alias("end")))


@query("bars_slice_windows", b.with_sql("indexed") + """, w AS (SELECT DISTINCT symbol, date_trunc('week', ts)::TIMESTAMP AS s FROM bars),
 e AS (SELECT w.symbol, epoch(w.s)::BIGINT AS window_id, count(*) FILTER (i.ts < w.s) + 1 AS start_no,
 count(*) FILTER (i.ts < w.s + INTERVAL 7 DAY) + 1 AS end_no FROM w JOIN indexed i USING (symbol) GROUP BY w.symbol, w.s)
 SELECT i.symbol, e.window_id, i.ts, i.row_no, i.row_no < e.start_no AS is_warmup FROM e JOIN indexed i
 ON i.symbol = e.symbol AND i.row_no >= e.start_no - 24 AND i.row_no < e.end_no""")
def bars_slice_windows(spark, d):
    i = b.indexed_bars(spark, d)
    return ob.slice_windows(i, week_windows(i), warmup=24).select("symbol", "window_id", "ts", "row_no", "is_warmup")


@query("bars_holdout_split", b.with_sql("daily") + """, s AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol),
 m AS (SELECT *, greatest(0, least(2, greatest(1, round(floor((epoch(hi) - epoch(lo)) / 86400) / 30.4375)::INT) - 9)) AS held FROM s)
 SELECT b.symbol, CASE WHEN b.ts >= m.hi - to_months(m.held::INT) THEN 'HELD_OUT' ELSE 'MAIN' END AS split,
 count(*) AS rows, min(b.ts) AS first_ts, max(b.ts) AS last_ts FROM bars b JOIN m USING (symbol) GROUP BY ALL""")
def bars_holdout_split(spark, d):
    i = b.indexed(b.daily_bars(spark, d), 86400)
    return ob.holdout_split(i).groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("bars_overlapping_ranges", b.with_sql("ticks") + """, r AS (SELECT symbol, 'opt' AS name, min(ts) AS s, min(ts) + INTERVAL 20 DAY AS e
 FROM ticks GROUP BY symbol UNION ALL SELECT symbol, 'test', min(ts) + INTERVAL 20 DAY, min(ts) + INTERVAL 25 DAY FROM ticks GROUP BY symbol
 UNION ALL SELECT symbol, 'held_out', max(ts) - INTERVAL 6 DAY, max(ts) FROM ticks GROUP BY symbol)
 SELECT a.symbol, a.name AS name_a, z.name AS name_b, greatest(a.s, z.s) AS overlap_start, least(a.e, z.e) AS overlap_end
 FROM r a JOIN r z ON a.symbol = z.symbol AND a.name < z.name AND a.s < z.e AND z.s < a.e""")
def bars_overlapping_ranges(spark, d):
    span = b.ticks(spark, d).groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    day = lambda n: F.expr(f"INTERVAL {n} DAYS")
    lo, hi = F.col("lo"), F.col("hi")
    part = lambda name, s, e: F.struct(F.lit(name).alias("name"), s.alias("start"), e.alias("end"))
    ranges = span.select("symbol", F.explode(F.array(
        part("opt", lo, lo + day(20)), part("test", lo + day(20), lo + day(25)),
        part("held_out", hi - day(6), hi))).alias("r")).select("symbol", "r.*")
    return ob.overlapping_ranges(ranges)


@query("bars_last_closed", b.with_sql("indexed") + """ SELECT symbol, ts, open, high, low, close FROM (SELECT *,
 max(row_no) OVER (PARTITION BY symbol) AS top FROM indexed) WHERE row_no < top AND row_no >= top - 300""")
def bars_last_closed(spark, d):
    return ob.last_closed(b.indexed_bars(spark, d)).select("symbol", "ts", "open", "high", "low", "close")


# ---- quality

@query("quality_profile", b.with_sql("daily") + """ SELECT symbol, timeframe, count(*) AS total_candles, min(ts)::DATE AS date_start,
 max(ts)::DATE AS date_end, round((epoch(max(ts)) - epoch(min(ts))) / 86400 / 365, 1) AS years_covered FROM bars GROUP BY ALL""", dates=('date_start', 'date_end'))
def quality_profile(spark, d):
    return quality.profile(b.daily_bars(spark, d))


@query("quality_duplicates", b.with_sql("ticks") + """ SELECT symbol, 'M1' AS timeframe,
 count(*) - count(DISTINCT date_trunc('minute', ts)) AS duplicates FROM ticks GROUP BY symbol""")
def quality_duplicates(spark, d):
    t = b.ticks(spark, d)
    return quality.duplicates(t.select("symbol", F.lit("M1").alias("timeframe"), F.date_trunc("minute", "ts").alias("ts")))


@query("quality_ohlc_violations", f"""WITH {_LINE_SQL}, {_CLEAN_SQL} SELECT symbol, count(*) AS violations FROM once
 WHERE high < greatest(open, close) OR low > least(open, close) OR high < low GROUP BY symbol""")
def quality_ohlc_violations(spark, d):
    once = sb.clean_minute_bars(sb.parse_minute_export(export_lines(spark, d)))
    return once.filter(quality.ohlc_violation()).groupBy("symbol").agg(F.count(F.lit(1)).alias("violations"))


_GAPS = """, st AS (SELECT symbol, timeframe, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap_start, ts AS gap_end FROM bars),
 g AS (SELECT *, (epoch(gap_end) - epoch(gap_start))::BIGINT AS gap_seconds FROM st WHERE epoch(gap_end) - epoch(gap_start) > {}),
 gc AS (SELECT *, CASE WHEN isodow(gap_start) = 5 THEN 'WEEKEND_FRIDAY' WHEN isodow(gap_start) = 6 THEN 'WEEKEND_SATURDAY'
 WHEN gap_seconds <= 14400 THEN 'SHORT' WHEN month(gap_end) = 12 AND day(gap_end) IN (26, 27, 28) THEN 'CHRISTMAS'
 WHEN month(gap_end) = 1 AND day(gap_end) IN (2, 3, 4) THEN 'NEW_YEAR' WHEN gap_seconds <= 432000 THEN 'HOLIDAY' END AS gap_class FROM g)"""


@query("quality_gaps", b.with_sql("bars") + _GAPS.format(5400) + """ SELECT symbol, timeframe, gap_start, gap_end, gap_seconds, gap_class FROM gc""")
def quality_gaps(spark, d):
    return quality.gaps(b.bars(spark, d)).select("symbol", "timeframe", "gap_start", "gap_end", "gap_seconds", "gap_class")


_SPARSE = """, sp AS (SELECT 'S' || l_suppkey AS symbol, 'D1' AS timeframe, l_shipdate AS ts, max(l_extendedprice) AS high,
 min(l_extendedprice) AS low, arg_min(l_extendedprice, l_orderkey * 1000000 + l_partkey) AS open, arg_max(l_extendedprice, l_orderkey * 1000000 + l_partkey) AS close, sum(l_quantity) AS volume
 FROM lineitem GROUP BY l_suppkey, l_shipdate), bars AS (SELECT * FROM sp)"""


def sparse_daily(spark, d):
    """Daily bars per supplier: years of history with many holes."""
    li = b.table(spark, d, "lineitem")
    place = F.col("l_orderkey") * 1000000 + F.col("l_partkey")
    return li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), b.utc("l_shipdate").alias("ts")).agg(
        F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        F.min_by("l_extendedprice", place).alias("open"), F.max_by("l_extendedprice", place).alias("close"),
        F.sum("l_quantity").alias("volume")).withColumn("timeframe", F.lit("D1"))


@query("quality_largest_gaps", "WITH x AS (SELECT 1)" + _SPARSE + _GAPS.format(129600) + """ SELECT symbol, timeframe, gap_start, gap_end,
 gap_seconds, dayname(gap_start) AS weekday FROM g WHERE isodow(gap_start) <> 5 AND gap_seconds > 14400
 ORDER BY gap_seconds DESC, symbol, timeframe, gap_end LIMIT 20""")
def quality_largest_gaps(spark, d):
    return quality.largest_gaps(sparse_daily(spark, d), 20)


@query("quality_check_all", "WITH x AS (SELECT 1)" + _SPARSE + _GAPS.format(129600) + """,
 r AS (SELECT symbol, timeframe, count(*) AS total_candles, count(*) - count(DISTINCT ts) AS duplicates,
 count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR high < low) AS ohlc_violations,
 (epoch(max(ts)) - epoch(min(ts))) / 86400 / 365 AS years, count(*) FILTER (volume = 0) * 100.0 / count(*) AS zero_pct,
 (SELECT count(*) FROM gc WHERE gc.symbol = bars.symbol AND gap_class IS NULL) AS unexpected_gaps FROM bars GROUP BY symbol, timeframe)
 SELECT e.symbol, e.timeframe, total_candles, duplicates, ohlc_violations, unexpected_gaps, round(years, 4) AS years,
 CASE WHEN total_candles IS NULL THEN 'MISSING' WHEN unexpected_gaps > 0 OR years < 3 THEN 'CRITICAL' WHEN duplicates > 0 OR ohlc_violations > 0
 THEN 'ISSUES' WHEN zero_pct > 5 THEN 'WARNINGS' ELSE 'OK' END AS status FROM (SELECT 'S' || s_suppkey AS symbol, t AS timeframe FROM supplier,
 (VALUES ('D1'), ('H4')) v(t)) e LEFT JOIN r USING (symbol, timeframe)""")
def quality_check_all(spark, d):
    expected = b.table(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.explode(F.array(F.lit("D1"), F.lit("H4"))).alias("timeframe"))
    return rounded(quality.check_all(sparse_daily(spark, d), expected), ["years"], 4).select(
        "symbol", "timeframe", "total_candles", "duplicates", "ohlc_violations", "unexpected_gaps", "years", "status")


# ---- calendar

_EET = """, z AS (SELECT *, timezone('UTC', timezone('Europe/Bucharest', exit_time)) AS u FROM trades),
 k AS (SELECT *, CASE WHEN timezone('Europe/Bucharest', timezone('UTC', u - INTERVAL 1 HOUR)) = exit_time THEN u - INTERVAL 1 HOUR ELSE u END AS as_utc FROM z),
 c AS (SELECT *, CASE WHEN timezone('Europe/Bucharest', timezone('UTC', as_utc + INTERVAL 1 HOUR)) = exit_time THEN 'REPEATED_FIRST'
  WHEN timezone('Europe/Bucharest', timezone('UTC', as_utc)) <> exit_time THEN 'MISSING_SHIFTED' ELSE 'REGULAR' END AS dst_rule FROM k)"""


@query("calendar_broker_time", b.with_sql("trades") + _EET + """ SELECT account, order_key, line_no, exit_time, as_utc,
 timezone('Europe/Bucharest', timezone('UTC', exit_time)) AS as_broker, round((epoch(exit_time) - epoch(as_utc)) / 3600.0, 2) AS offset_hours FROM c""")
def calendar_broker_time(spark, d):
    """Exit times read once as broker-local and once as UTC."""
    ts = F.col("exit_time")
    return b.trades(spark, d).select(
        "account", "order_key", "line_no", "exit_time", calendar.broker_to_utc(ts).alias("as_utc"),
        calendar.utc_to_broker(ts).alias("as_broker"), F.round(calendar.broker_offset_hours(ts), 2).alias("offset_hours"))


@query("calendar_broker_column", b.with_sql("trades") + _EET + """ SELECT account, exit_time, dst_rule, count(*) AS n,
 max(CASE dst_rule WHEN 'MISSING_SHIFTED' THEN date_trunc('hour', as_utc) ELSE as_utc END)::TIMESTAMP AS ts_utc
 FROM c GROUP BY account, exit_time, dst_rule""")
def calendar_broker_column(spark, d):
    """Exit times read as broker-local times; in time order they never step back."""
    t = b.trades(spark, d).select("account", F.unix_seconds("exit_time").alias("seq"), "exit_time")
    return (calendar.broker_column_to_utc(t, ["account"], "seq", "exit_time")
            .groupBy("account", "exit_time", "dst_rule").agg(F.count(F.lit(1)).alias("n"), F.max("ts_utc").alias("ts_utc")))


@query("calendar_session", b.with_sql("ticks") + f""" SELECT symbol, {b.session_sql('ts')} AS session, hour(ts) AS hour_utc, isodow(ts) - 1 AS day_of_week,
 count(*) AS n FROM ticks GROUP BY ALL""")
def calendar_session(spark, d):
    ts = F.col("ts")
    return b.ticks(spark, d).groupBy("symbol", calendar.session_label(ts).alias("session"), F.hour(ts).cast("bigint").alias("hour_utc"),
                                     calendar.day_of_week(ts).cast("bigint").alias("day_of_week")).agg(F.count(F.lit(1)).alias("n"))


_ROLL = """ SELECT symbol, ts, close, {day} AS day, lag({day}) OVER w IS NOT NULL AND {day} > lag({day}) OVER w AS is_rollover,
 first_value(close) OVER (PARTITION BY symbol, {day} ORDER BY ts) AS day_start_value FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""


@query("calendar_utc_rollover", b.with_sql("bars") + _ROLL.format(day="ts::DATE"), dates=('day',))
def calendar_utc_rollover(spark, d):
    return calendar.day_rollover(b.bars(spark, d).select("symbol", "ts", "close"), ["symbol"], "ts", "close", F.to_date("ts"))


@query("calendar_mandate_rollover", b.with_sql("bars") + _ROLL.format(day="timezone('Europe/Prague', timezone('UTC', ts))::DATE"), dates=('day',))
def calendar_mandate_rollover(spark, d):
    return calendar.day_rollover(b.bars(spark, d).select("symbol", "ts", "close"), ["symbol"], "ts", "close",
                                 calendar.mandate_date(F.col("ts")))


@query("calendar_swap_nights", b.with_sql("trades") + """ SELECT account, entry_time, exit_time, count(*) AS n, max((SELECT coalesce(sum(CASE isodow(m) WHEN 3 THEN 3
 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END), 0)::BIGINT FROM (SELECT entry_time::DATE::TIMESTAMP + INTERVAL 21 HOUR + to_days(k::INT) AS m FROM range(0, 4) r(k)) x
 WHERE m > entry_time AND m < exit_time)) AS nights FROM trades GROUP BY account, entry_time, exit_time""")
def calendar_swap_nights(spark, d):
    return b.trades(spark, d).groupBy("account", "entry_time", "exit_time").agg(
        F.count(F.lit(1)).alias("n"), F.max(calendar.rollover_nights(F.col("entry_time"), F.col("exit_time"))).alias("nights"))


@query("calendar_elapsed_years", b.with_sql("trades") + """ SELECT account, round(greatest((epoch(max(exit_time)) - epoch(min(entry_time)))
 / (365.25 * 86400), 1.0 / 252), 6) AS years FROM trades GROUP BY account""")
def calendar_elapsed_years(spark, d):
    return b.trades(spark, d).groupBy("account").agg(
        F.round(calendar.elapsed_years(F.min("entry_time"), F.max("exit_time")), 6).alias("years"))


@query("calendar_timeframe_minutes", b.with_sql("bars") + """ SELECT symbol, timeframe, 60 AS minutes, count(*) AS n FROM bars GROUP BY ALL""")
def calendar_timeframe_minutes(spark, d):
    return b.bars(spark, d).groupBy("symbol", "timeframe", calendar.timeframe_minutes(F.col("timeframe")).alias("minutes")).agg(
        F.count(F.lit(1)).alias("n"))
