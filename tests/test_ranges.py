"""Overlapping ranges by a sweep, and codes of rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.operators import bars as ob
from candlewick.operators import signals

T0 = datetime(2024, 1, 1)
SCHEMA = "symbol string, name string, start timestamp, end timestamp"


def pairs(rows):
    out = []
    for i, (s, n, a, z) in enumerate(rows):
        for t, m, c, y in rows[i + 1:]:
            if s == t and s is not None and n != m and None not in (a, z, c, y) and a < y and c < z:
                out.append((s, *sorted((n, m)), max(a, c), min(z, y)))
    return sorted(out)


def test_overlaps_equal_a_loop(spark):
    """Ties, empty and reversed ranges, equal names, nulls, one range over all others."""
    rng = random.Random(5)
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("A", f"r{i % 150}", at(s := rng.randint(0, 300)), at(s + rng.choice([-2, 0, 1, 3, 8]))) for i in range(160)]
    rows += [("A", "all", at(-1), at(400)), ("B", "x", at(0), at(5)), ("B", "y", at(5), at(9)), ("B", "z", at(4), at(6)), (None, "n", at(0), at(9)), (None, "m", at(0), at(9)), ("B", "open", at(0), None)]
    rng.shuffle(rows)
    got = ob.overlapping_ranges(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == pairs(rows)
    assert ob.overlapping_ranges(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_ranges_of_one_symbol(spark):
    """100 000 ranges of which few overlap, and one that covers 20 000 of them: the join makes as many rows as there are overlaps."""
    hour = lambda c: F.timestamp_seconds(c.cast("long") * 3600)
    i = F.col("id")
    many = spark.range(100_000).select(F.lit("A").alias("symbol"), F.concat(F.lit("r"), i).alias("name"), hour(i * 2).alias("start"), hour(i * 2 + F.when(i % 1000 == 0, 3).otherwise(1)).alias("end"))
    wide = spark.range(1).select(F.lit("A").alias("symbol"), F.lit("wide").alias("name"), hour(F.lit(50_001)).alias("start"), hour(F.lit(90_001)).alias("end"))
    got = ob.overlapping_ranges(many.unionByName(wide))
    assert got.filter("name_b = 'wide'").count() == 20_001 and got.count() == 20_001 + 100  # r25000 reaches into it


@pytest.mark.parametrize(("row", "want"), [
    (("DEAD_ZONE", 1.0, 30.0), "closed_hours"), (("ASIAN", 1.0, 30.0), "unlisted_session session=ASIAN"), (("LONDON", 0.5, 30.0), "quiet_market atr_ratio=0.5 limit=0.8"),
    (("LONDON", 1.5, 30.0), "wild_market atr_ratio=1.5 limit=1.3"), (("LONDON", None, 30.0), None), ((None, 1.0, 30.0), None), (("LONDON", 1.0, 30.0), None)])
def test_block_codes(spark, row, want):
    df = spark.createDataFrame([row], "session string, atr_ratio double, adx double")
    p = {"allowed_sessions": ["LONDON"], "atr_ratio_min": 0.8, "atr_ratio_max": 1.3}
    assert df.select(signals.block_reason(p)).first()[0] == want
    assert df.select(signals.adx_block({"adx_threshold": 20})).first()[0] is None


def test_trend_and_mandate_codes(spark):
    df = spark.createDataFrame([(10.0,), (None,)], "adx double")
    assert [r[0] for r in df.select(signals.adx_block({"adx_threshold": 20})).collect()] == ["weak_trend adx=10.0 limit=20.0", "unknown_trend limit=20.0"]
    assert [r[0] for r in df.select(signals.adx_block({"adx_threshold": 20}, live=True)).collect()] == ["weak_trend adx=10.0 limit=20.0", None]
    src = spark.createDataFrame([("eurusd", False, 2.0, False, True), ("x", False, 0.1, False, False), ("eurusd", False, 0.1, False, False), ("eurusd", None, 0.1, None, None)],
                                "symbol string, safe_mode boolean, risk_per_trade_pct double, breaker_tripped boolean, daily_halt boolean")
    got = signals.mandate_gate(src, {"symbol_universe": ["EURUSD"], "max_daily_risk_pct": 1.0}).collect()
    assert [(r.gate_reason, r.violations, r.allowed) for r in got] == [
        ("risk_too_high risk=2.0 limit=1.0", ["risk_too_high", "day_halted"], False), ("symbol_not_traded symbol=X", ["symbol_not_traded"], False), ("pass", [], True), ("pass", [], True)]
    assert {r.gate_reason for r in signals.mandate_gate(src, None).collect()} == {"without_mandate"}
