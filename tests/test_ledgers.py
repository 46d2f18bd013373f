"""Append-only tables."""

from datetime import datetime

from pyspark.sql import functions as F

from candlewick.operators import history, promotion
from candlewick.sources import logs
from candlewick.streaming.monitor import event_sink


def test_audit_performance_and_trials(spark, tmp_path):
    a = spark.createDataFrame([("BREACH", "M", {"pct": "4.2"})], "event_type string, mandate_id string, details map<string,string>")
    for _ in range(2):
        logs.append_audit(a, str(tmp_path / "audit"))
    got = spark.read.json(str(tmp_path / "audit"))
    assert got.count() == 2 and got.filter("timestamp IS NOT NULL AND details.pct = '4.2'").count() == 2
    p = spark.createDataFrame([("ENGINE", "EVAL", float(i)) for i in range(11)], "source_system string, metric_type string, ms double")
    logs.append_performance(p, str(tmp_path / "perf"))
    s = logs.performance_summary(spark.read.parquet(str(tmp_path / "perf")), "ms", exact=True).first()
    assert (s.n, s["mean"], s.median, s["max"]) == (11, 5.0, 5.0, 10.0)
    t = spark.createDataFrame([("ma_crossover", 0.5, {"fast_ma_period": "5", "pip_size": "0.1"})], "template string, composite_score double, parameters map<string,string>")
    history.append_trials(t, str(tmp_path / "trials"))
    assert spark.read.parquet(str(tmp_path / "trials")).first().parameters == {"fast_ma_period": "5"}


def test_decision_ids_and_candle_events(spark, tmp_path):
    d = promotion.decision_records(spark.createDataFrame([("c1",)], "candidate_id string"), F.lit("r1")).first()
    import hashlib
    assert d.decision_id == hashlib.sha256(b"r1_c1").hexdigest()[:12]
    sink = event_sink(str(tmp_path / "ev"))
    batch = spark.createDataFrame([("A", datetime(2026, 1, 1), True)], "symbol string, ts timestamp, all_passed boolean")
    sink(batch, 0)
    sink(batch, 0)  # a replayed batch changes nothing
    assert spark.read.json(str(tmp_path / "ev")).count() == 1


def test_upsert_keeps_old_values(spark):
    b = spark.createDataFrame([("s1", "READY", 0.5)], "strategy_id string, status string, score double")
    c = spark.createDataFrame([("s1", None, 0.7), ("s2", "READY", 0.1)], "strategy_id string, status string, score double")
    assert sorted(tuple(r) for r in promotion.upsert(b, c).collect()) == [("s1", "READY", 0.7), ("s2", "READY", 0.1)]
