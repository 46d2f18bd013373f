"""Queries over logs built from the events table."""

from pyspark.sql import functions as F

from candlewick import bindings as b
from candlewick.functions.staging import fresh_folder, stage
from candlewick.plans.bar_queries import rounded
from candlewick.plans.registry import ORACLES, query
from candlewick.sources import log_store, logs

_LV = "CASE WHEN value > 50 THEN 'ERROR' WHEN value > 20 THEN 'WARNING' ELSE 'INFO' END"
# Every third event is a text line, a JSON line or a state snapshot; a few lines are broken.
_SRC = f"""WITH e AS (SELECT *, {_LV} AS lv, strftime(ts, '%Y%m%d') AS dd, CASE WHEN event_id % 2 = 0 THEN 'engine' ELSE 'trainer' END AS sys FROM events),
 l AS MATERIALIZED (SELECT *, CASE event_id % 3 WHEN 0 THEN sys || '_' || dd || '.log' WHEN 1 THEN sys || '_' || dd || '.jsonl' ELSE 'other_' || dd || '.json' END AS path,
 CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 29 = 0 THEN 'free text ' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ',123 | ' || lv || ' | user ' || user_id || ' did ' || event_type END
 WHEN 1 THEN CASE WHEN event_id % 31 = 0 THEN '{{broken' WHEN event_id % 7 = 0 THEN '{{"created_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z","metric_type":"LATENCY","details":"' || event_type || '","error":"x"}}'
  ELSE '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00","event_type":"' || event_type || '_FAILURE","message":"user ' || user_id || '"}}' END
 ELSE '{{"updated_at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","status":"' || CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'OK' END || '"}}' END AS line FROM e),
 en AS MATERIALIZED (SELECT event_id, path AS source_file, CASE WHEN event_id % 3 = 2 THEN 'UNKNOWN' ELSE upper(sys) END AS source_system,
 CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 29 = 0 THEN 'INFO' ELSE lv END WHEN 1 THEN 'ERROR' ELSE CASE WHEN event_id % 5 = 0 THEN 'ERROR' ELSE 'INFO' END END AS level,
 CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 29 = 0 THEN 'LOG_LINE_RAW' ELSE 'LOG_LINE' END WHEN 1 THEN CASE WHEN event_id % 7 = 0 THEN 'LATENCY' ELSE event_type || '_FAILURE' END ELSE 'STATE_SNAPSHOT' END AS event_type,
 CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 29 = 0 THEN line ELSE 'user ' || user_id || ' did ' || event_type END WHEN 1 THEN CASE WHEN event_id % 7 = 0 THEN event_type ELSE 'user ' || user_id END ELSE line END AS message,
 CASE WHEN event_id % 3 = 0 AND event_id % 29 = 0 THEN TIMESTAMP '2024-02-01' WHEN event_id % 3 = 0 THEN date_trunc('second', ts)::TIMESTAMP + INTERVAL 123 MILLISECOND ELSE date_trunc('second', ts)::TIMESTAMP END AS ts FROM l WHERE NOT (event_id % 3 = 1 AND event_id % 31 = 0))""".replace("{{", "{").replace("}}", "}")
NOW = "2024-02-01 00:00:00"


def log_lines(spark, d):
    e = b.table(spark, d, "events")
    i, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    lv = F.when(F.col("value") > 50, "ERROR").when(F.col("value") > 20, "WARNING").otherwise("INFO")
    fmt = lambda p: F.date_format("ts", p)
    system, day = F.when(i % 2 == 0, "engine").otherwise("trainer"), fmt("yyyyMMdd")
    path = F.when(i % 3 == 0, F.concat(system, F.lit("_"), day, F.lit(".log"))).when(i % 3 == 1, F.concat(system, F.lit("_"), day, F.lit(".jsonl"))).otherwise(
        F.concat(F.lit("other_"), day, F.lit(".json")))
    text = F.when(i % 29 == 0, F.concat(F.lit("free text "), i)).otherwise(F.concat(fmt("yyyy-MM-dd HH:mm:ss"), F.lit(",123 | "), lv, F.lit(" | user "), u, F.lit(" did "), t))
    iso = fmt("yyyy-MM-dd'T'HH:mm:ss")
    jsonl = (F.when(i % 31 == 0, "{broken").when(i % 7 == 0, F.concat(F.lit('{"created_at":"'), iso, F.lit('Z","metric_type":"LATENCY","details":"'), t, F.lit('","error":"x"}')))
             .otherwise(F.concat(F.lit('{"timestamp":"'), iso, F.lit('+00:00","event_type":"'), t, F.lit('_FAILURE","message":"user '), u, F.lit('"}'))))
    snap = F.concat(F.lit('{"updated_at":"'), fmt("yyyy-MM-dd HH:mm:ss"), F.lit('","status":"'), F.when(i % 5 == 0, "FAILED").otherwise("OK"), F.lit('"}'))
    return stage(e.select(path.alias("path"), F.when(i % 3 == 0, text).when(i % 3 == 1, jsonl).otherwise(snap).alias("line"), i.alias("line_no")))


def entries(spark, d):
    return logs.parse_entries(log_lines(spark, d), F.lit(NOW).cast("timestamp"))


@query("log_entries", _SRC + " SELECT source_file, source_system, level, event_type, message, ts FROM en")
def log_entries(spark, d):
    e = entries(spark, d)
    return e.select("source_file", "source_system", "level", "event_type", "message", logs.parse_timestamp(F.col("timestamp")).alias("ts"))


@query("log_query", _SRC + " SELECT source_file, event_type, message, ts FROM en WHERE level = 'ERROR' AND source_system = 'ENGINE' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND (contains(lower(message), 'user 1') OR contains(lower(event_type), 'user 1'))")
def log_query(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    q = logs.query_entries(entries(spark, d), "error", "engine", at("2024-01-05"), at("2024-01-20"), "USER 1")
    return q.select("source_file", "event_type", "message", "ts")


@query("log_since_hours", _SRC + " SELECT source_file, level, message, ts FROM en WHERE ts >= TIMESTAMP '2024-01-29' ORDER BY ts DESC, message DESC, source_file LIMIT 50")
def log_since_hours(spark, d):
    return logs.since_hours(entries(spark, d), 72, F.lit(NOW).cast("timestamp")).select("source_file", "level", "message", "ts")


@query("log_dates", "SELECT d::DATE AS date, d = DATE '2024-02-01' AS is_today FROM (SELECT DISTINCT ts::DATE AS d FROM events UNION SELECT DATE '2024-02-01')", dates=("date",))
def log_dates(spark, d):
    return logs.log_dates(log_lines(spark, d).select("path"), F.lit(NOW).cast("timestamp"))


@query("log_day_lines", _SRC + " SELECT path, line FROM l WHERE path = 'engine_20240110.log' ORDER BY event_id DESC LIMIT 20")
def log_day_lines(spark, d):
    return logs.day_lines(log_lines(spark, d), "engine", "2024-01-10", 20).select("path", "line")


@query("log_tail_valid", _SRC + " SELECT event_id AS line_no, line FROM l WHERE event_id % 3 <> 0 AND NOT (event_id % 3 = 1 AND event_id % 31 = 0) ORDER BY event_id DESC LIMIT 50")
def log_tail_valid(spark, d):
    return logs.tail_valid(log_lines(spark, d), 50).select("line_no", "line")


_REC = """WITH r AS (SELECT event_id, 'trades_' || strftime(ts, '%Y%m%d') || '.jsonl' AS path, ts, value, event_id % 37 = 0 AS broken, event_id % 6 = 0 AS is_event FROM events)"""


def record_lines(spark, d):
    i = F.col("event_id")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    trade = F.concat(F.lit('{"schema_version":"1.0","trade_id":"T'), i, F.lit('","exit_time":"'), ts, F.lit('","net_pnl":'), F.col("value").cast("string"), F.lit("}"))
    event = F.concat(F.lit('{"record_type":"EVENT","event_type":"'), F.col("event_type"), F.lit('","event_time":"'), ts, F.lit('"}'))
    return b.table(spark, d, "events").select(
        F.concat(F.lit("trades_"), F.date_format("ts", "yyyyMMdd"), F.lit(".jsonl")).alias("path"),
        F.when(i % 37 == 0, '{"trade_id": broken').when(i % 6 == 0, event).otherwise(trade).alias("line"))


@query("log_recent_trades", _REC + " SELECT 'T' || event_id AS trade_id, value AS net_pnl FROM r WHERE NOT broken AND NOT is_event ORDER BY ts DESC LIMIT 50")
def log_recent_trades(spark, d):
    return logs.recent_trades(logs.parse_records(record_lines(spark, d)), 50).select("trade_id", "net_pnl")


@query("log_event_records", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 6 = 0 AND event_id % 37 <> 0 GROUP BY event_type")
def log_event_records(spark, d):
    return logs.event_records(logs.parse_records(record_lines(spark, d))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("log_incremental_manifest", _REC + " SELECT path, count(*) FILTER (NOT broken AND NOT is_event) AS trades, count(*) AS lines FROM r WHERE path > 'trades_20240110.jsonl' GROUP BY path")
def log_incremental_manifest(spark, d):
    lines = record_lines(spark, d)
    done = lines.filter(F.col("path") <= "trades_20240110.jsonl").select("path").distinct()
    return logs.processed_counts(logs.unprocessed(lines, done))


def performance_records(spark, d):
    return b.table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "ENGINE").otherwise("TRAINER").alias("source_system"), F.col("event_type").alias("metric_type"), "value",
                                              F.col("ts").cast("timestamp").alias("timestamp"))


@query("log_performance_summary", "SELECT CASE WHEN user_id % 2 = 0 THEN 'ENGINE' ELSE 'TRAINER' END AS source_system, event_type AS metric_type, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.95), 5) AS p95, max(value) AS max FROM events GROUP BY ALL")
def log_performance_summary(spark, d):
    return rounded(logs.performance_summary(performance_records(spark, d), "value", exact=True), ["mean", "median", "p95"], 5)


@query("log_performance_sketches", """WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'ENGINE' ELSE 'TRAINER' END AS source_system, event_type AS metric_type, value FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
 SELECT source_system, metric_type, count(*) AS n, round(avg(value), 5) AS mean, max(value) AS max, TRUE AS median_close, TRUE AS p95_close, TRUE AS n_values_close FROM r GROUP BY ALL""")
def log_performance_sketches(spark, d):
    """Sketches per day and source, merged for a range of days: exact counts, and whether the estimates are as close as stated."""
    r = performance_records(spark, d)
    span = F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))
    keys = ["source_system", "metric_type"]
    # the daily rows are what a store would keep
    merged = logs.merged_sketches(stage(logs.performance_sketches(r, "value")).filter(span))
    days = r.withColumn("day", F.to_date("timestamp")).filter(span)
    at = days.join(merged.select(*keys, "q50", "q95"), keys).groupBy(*keys).agg(
        *[(F.count_if(F.col("value") < F.col(q)) / F.count("value")).alias(f"{q}_below") for q in ("q50", "q95")],
        *[(F.count_if(F.col("value") <= F.col(q)) / F.count("value")).alias(f"{q}_upto") for q in ("q50", "q95")], F.countDistinct("value").alias("_exact"))
    e = logs.RANK_ERROR
    close = lambda q, p: (F.col(f"{q}_below") - e <= p) & (p <= F.col(f"{q}_upto") + e)
    out = merged.join(at, keys).select(*keys, "n", "mean", "max", close("q50", 0.5).alias("median_close"), close("q95", 0.95).alias("p95_close"),
                                       (F.abs(F.col("n_values") - F.col("_exact")) <= 0.05 * F.col("_exact")).alias("n_values_close"))
    return rounded(out, ["mean"], 5)


def indexed_log(spark, d):
    """The log lines in a store of their own, added in two calls of which the second repeats the files of the first."""
    folder, lines = fresh_folder(spark), log_lines(spark, d).select("path", "line")
    log_store.add(lines.filter(F.col("path").contains("202401")), folder)
    log_store.add(lines, folder)
    return folder


@query("log_store_query", ORACLES["log_query"])
def log_store_query(spark, d):
    """``log_query`` over a store: only parts that may hold a match are opened."""
    at = lambda s: F.lit(s).cast("timestamp")
    q = log_store.query(spark, indexed_log(spark, d), "error", "engine", at("2024-01-05"), at("2024-01-20"), "USER 1", at(NOW))
    return q.select("source_file", "event_type", "message", "ts")


@query("log_store_manifest", _SRC + """, own AS (SELECT source_file, count(*) AS entries, min(ts) FILTER (event_type <> 'LOG_LINE_RAW') AS first, max(ts) FILTER (event_type <> 'LOG_LINE_RAW') AS last,
 count(*) FILTER (event_type = 'LOG_LINE_RAW') AS timeless FROM en GROUP BY source_file)
 SELECT path, count(*) AS lines, coalesce(any_value(entries), 0) AS entries, any_value(first) AS first, any_value(last) AS last, coalesce(any_value(timeless), 0) AS timeless
 FROM l LEFT JOIN own ON path = source_file GROUP BY path""")
def log_store_manifest(spark, d):
    """What the store knows of every file."""
    return log_store.files(spark, indexed_log(spark, d)).groupBy("path").agg(
        F.sum("lines").alias("lines"), F.sum("entries").alias("entries"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("timeless").alias("timeless"))


_CLOSED = """SELECT 'E' || event_id AS trade_id, event_type AS symbol, value AS net_pnl, ts AS exit_time, strftime(ts, '%Y%m%d') AS day FROM events"""


def closed_trades(spark, d):
    return b.table(spark, d, "events").select(F.concat(F.lit("E"), "event_id").alias("trade_id"), F.col("event_type").alias("symbol"), F.col("value").alias("net_pnl"), b.utc("ts").alias("exit_time"))


@query("log_written_trades", f"""WITH t AS ({_CLOSED}) SELECT day, 'TRADE' AS kind, symbol, count(*) AS n, round(sum(net_pnl), 4) AS net_pnl FROM t GROUP BY ALL
 UNION ALL SELECT day, 'EVENT', symbol, count(*), NULL FROM t GROUP BY ALL""")
def log_written_trades(spark, d):
    """Trades and events appended to the log of their day, read back and told apart."""
    folder, t = fresh_folder(spark), closed_trades(spark, d)
    logs.append_trades(t, folder)
    logs.append_events(t.select(F.col("symbol"), F.lit("CANDLE").alias("event_type"), F.col("exit_time").alias("event_time")), folder)
    r = stage(logs.read_log(spark, folder))
    part = lambda rows, kind, pnl: rows.groupBy(F.col("day").cast("string").alias("day"), F.lit(kind).alias("kind"), "symbol").agg(F.count(F.lit(1)).alias("n"), pnl.alias("net_pnl"))
    return part(logs.trade_records(r), "TRADE", F.round(F.sum("net_pnl"), 4)).unionByName(part(logs.event_records(r), "EVENT", F.max(F.lit(None).cast("double"))))


@query("log_compacted_days", f"""WITH t AS ({_CLOSED}) SELECT day, count(*) AS n, round(sum(net_pnl), 4) AS net_pnl, TRUE AS packed FROM t WHERE day < '20240115' GROUP BY day""")
def log_compacted_days(spark, d):
    """Old days of the written log as gzip, read back from the packed files alone."""
    folder, out = fresh_folder(spark), fresh_folder(spark)
    logs.append_trades(closed_trades(spark, d), folder)
    logs.compact_old_days(spark, folder, out, "20240115")
    lines = spark.read.schema("line string, day string").option("basePath", out).text(out).withColumn("packed", F.col("_metadata.file_name").endswith(".gz"))
    t = logs.trade_records(logs.parse_records(lines))
    return t.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net_pnl"), 4).alias("net_pnl"), F.bool_and("packed").alias("packed"))


@query("log_audit_trail", """SELECT 'BREACH' AS event_type, event_type AS mandate_id, count(*) AS n, max(user_id)::VARCHAR AS top_user, TRUE AS stamped FROM events WHERE value > 50 GROUP BY event_type
 UNION ALL SELECT 'CHECK', event_type, count(*), max(user_id)::VARCHAR, TRUE FROM events WHERE value <= 50 GROUP BY event_type""")
def log_audit_trail(spark, d):
    """Audit events appended in two writes, read back with their details."""
    folder, e = fresh_folder(spark), b.table(spark, d, "events")
    for kind, rows in (("BREACH", e.filter("value > 50")), ("CHECK", e.filter("value <= 50"))):
        logs.append_audit(rows.select(F.lit(kind).alias("event_type"), F.col("event_type").alias("mandate_id"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("details")), folder)
    back = spark.read.schema("event_type string, mandate_id string, details map<string, string>, timestamp timestamp").json(folder)
    return back.groupBy("event_type", "mandate_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("details.user").cast("bigint")).cast("string").alias("top_user"),
                                                        F.bool_and(F.col("timestamp").isNotNull()).alias("stamped"))
