"""Paths through forests of successors against a loop, with slots small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from candlewick.functions import forest

SCHEMA = "k string, j int, at bigint, free bigint, extra string"


def follow(rows):
    out = set()
    for key in {r[:2] for r in rows}:
        place = None
        for _, _, at, free, _ in sorted((r for r in rows if r[:2] == key and r[2] is not None), key=lambda r: r[2]):
            if place is None or at >= place:
                out.add((*key, at))
                place = float("inf") if free is None else free
    return out


@pytest.mark.parametrize(("size", "fan"), [(8, 16), (1 << 16, 64)])
def test_path_equals_loop(spark, size, fan):
    rng = random.Random(size)
    rows = []
    for k, j, n, reach in (("hot", 1, 900, 9), ("hot", 2, 300, 90), (None, 1, 60, 5), ("c", None, 40, 400), ("one", 1, 1, 1)):
        for at in sorted(rng.sample(range(-50, 3 * n), n)):
            rows.append((k, j, at, rng.choice([None, at, at + 1] + [at + rng.randint(1, reach)] * 60), "x"))
    rows.append(("hot", 1, None, 5, "no place"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    got = forest.path(df, ["k", "j"], "at", "free", size, fan)
    assert got.columns == df.columns
    found = [(r.k, r.j, r.at) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == follow(rows)


def test_parallel_paths_that_never_meet(spark):
    """Every row leads 37 places on, so 37 paths run side by side through all levels."""
    df = spark.range(2000).select(F.lit("k").alias("k"), F.col("id").alias("at"), (F.col("id") + 37).alias("free"))
    assert sorted(r.at for r in forest.path(df, ["k"], "at", "free", 8, 32).collect()) == list(range(0, 2000, 37))


def test_empty_and_without_places(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert forest.path(empty, ["k", "j"], "at", "free").count() == 0
    assert forest.path(spark.createDataFrame([("a", 1, None, 3, "x")], SCHEMA), ["k"], "at", "free").count() == 0


def test_no_task_gathers_a_key(spark):
    """One key of 120 000 overlapping rows: no slot handed to Python holds more rows than its size."""
    df = spark.range(120_000).select(F.lit("k").alias("k"), F.col("id").alias("at"), (F.col("id") + 5 + F.col("id") % 11).alias("free"))
    met = forest.path(df, ["k"], "at", "free", 1024, 128)
    place, want = 0, []
    while place < 120_000:
        want.append(place)
        place += 5 + place % 11
    assert sorted(r.at for r in met.collect()) == want
    rows = df.select(F.struct("k", F.lit(0).alias("_")).alias("_k"), F.col("at").alias("_at"), F.col("free").alias("_free"))
    sizes = forest._by_slot(rows, 1024, lambda t, n: t.set_column(2, "_free", [t.column("_pos").to_numpy().astype("int64")])).agg(F.max("_free")).first()[0]
    assert sizes <= 1024
