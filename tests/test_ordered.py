"""Chunked ordered computations against plain loops, with chunks small enough to matter."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.functions import ordered

KEYS = ["k"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # one key holds most rows
    data = [("hot", i, rng.gauss(0, 5)) for i in range(700)] + [(f"c{j}", i, rng.gauss(0, 5)) for j in range(5) for i in range(20)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, t bigint, x double").cache()


def per_key(data):
    out = {}
    for k, t, x in sorted(data):
        out.setdefault(k, []).append((t, x))
    return out


def test_index_rows(rows):
    data, df = rows
    got = {(r.k, r.t): r.row_no for r in ordered.index_rows(df, KEYS, [F.col("t")], F.floor(F.col("t") / 37)).collect()}
    assert got == {(k, t): i + 1 for k, v in per_key(data).items() for i, (t, _) in enumerate(v)}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(rows, descending, exclusive):
    data, df = rows
    sparse = F.when(F.col("t") % 5 == 0, F.col("x"))
    got = ordered.running(df, KEYS, ["t"], F.floor(F.col("t") / 23), {
        "s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "la": ("last", sparse)},
        descending=descending, exclusive=exclusive).toPandas().set_index(["k", "t"]).sort_index()
    for k, v in per_key(data).items():
        seen = []
        for t, x in (reversed(v) if descending else v):
            before = list(seen)
            seen.append((t, x))
            use = before if exclusive else seen
            r = got.loc[(k, t)]
            assert math.isclose(r.s, sum(x for _, x in use), abs_tol=1e-8)
            marked = [x for t2, x in use if t2 % 5 == 0]
            for name, want in (("hi", max((x for _, x in use), default=None)), ("lo", min((x for _, x in use), default=None)),
                               ("la", marked[-1] if marked else None)):
                assert (pd.isna(r[name]) and want is None) or math.isclose(r[name], want)


def test_walk_matches_reflected_loop(rows):
    data, df = rows
    got = ordered.running(df, KEYS, ["t"], F.floor(F.col("t") / 23), {"w": ("walk", F.col("x"))}).toPandas().set_index(["k", "t"])
    for k, v in per_key(data).items():
        s = c = 0.0
        top = 0.0
        for t, x in v:
            s, c = max(0.0, s + x), c + x
            top = max(top, c)
            r = got.loc[(k, t)]
            assert math.isclose(r.w - r.w_low, s, abs_tol=1e-8)
            assert math.isclose(r.w_high, top, abs_tol=1e-8)


@pytest.mark.parametrize(("n", "alpha", "size"), [(3, 0.5, 40), (14, 1 / 14, 100), (1, 1.0, 50), (100, 2 / 101, 64)])
def test_recurrence(rows, n, alpha, size):
    data, df = rows
    idx = ordered.index_rows(df, KEYS, [F.col("t")], F.floor(F.col("t") / 37))
    halo = ordered.recurrence_halo(alpha) + n
    assert halo + size <= ordered.recurrence_rows(alpha)
    cut = ordered.spread(idx, halo, size)
    seed = F.avg("x").over(ordered.chunk_window(KEYS).rowsBetween(-(n - 1), 0))
    got = ordered.own_rows(cut.withColumn("y", ordered.recurrence(F.col("x"), seed, n, alpha, KEYS, halo, size))).toPandas()
    assert len(got) == len(data)
    got = got.set_index(["k", "row_no"]).y
    for k, v in per_key(data).items():
        xs = [x for _, x in v]
        y = None
        for i, x in enumerate(xs, 1):
            if i == n:
                y = sum(xs[:n]) / n
            elif i > n:
                y = y + alpha * (x - y)
            assert (y is None and pd.isna(got.loc[(k, i)])) or math.isclose(got.loc[(k, i)], y, abs_tol=1e-9)


def test_spread_bounds_every_chunk(rows):
    _, df = rows
    idx = ordered.index_rows(df, KEYS, [F.col("t")], F.floor(F.col("t") / 37))
    biggest = ordered.spread(idx, 10, 50).groupBy("k", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= 60


def test_time_slices_bound_a_hot_key(spark):
    """Thousands of rows of one key and day fall into many slices that follow time; null times stay together."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").otherwise("cold").alias("k"),
                                      F.when(F.col("id") != 5, F.timestamp_micros(F.col("id") * 4_000_000 + F.lit(1_700_000_000_000_000))).alias("t"))
    cut = ordered.time_slices(rows, ["k"], "t", "s", rows=500)
    groups = cut.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("s IS NOT NULL").orderBy("k", "s").collect()
    assert cut.count() == 20_000 and max(r.n for r in groups) <= 1000
    assert all(a.hi < b.lo for a, b in zip(groups, groups[1:]) if a.k == b.k)


def test_averages_far_apart(spark):
    from candlewick.operators import indicators as ind

    rng = random.Random(2)
    close = [100 + rng.gauss(0, 3) for _ in range(900)]
    rows = spark.createDataFrame([("A", i + 1, None, c, c, c, c, 1.0) for i, c in enumerate(close)],
                                 "symbol string, row_no bigint, ts timestamp, open double, high double, low double, close double, volume double")

    def ema(x, n, first):
        out, a = [None] * len(x), 2 / (n + 1)
        for k in range(first + n - 1, len(x)):
            out[k] = sum(x[first:first + n]) / n if k == first + n - 1 else out[k - 1] + a * (x[k] - out[k - 1])
        return out

    line = [None if s is None else f - s for f, s in zip(ema(close, 3, 0), ema(close, 200, 0))]
    want = list(zip(line, ema(line, 9, 199)))
    got = [(r.macd, r.macd_signal) for r in ind.macd(rows, 3, 200, 9).orderBy("row_no").collect()]
    assert all(g == w if w is None else g == pytest.approx(w, abs=1e-9) for a, b in zip(got, want) for g, w in zip(a, b))
    assert ind.features(rows, {"rsi_period": 2, "slow_ma_period": 400}).count() == 900


def average_loop(xs, n, alpha, first):
    """y = y + alpha * (x - y) over known inputs, seeded with the mean of the known ones of rows first .. first + n - 1."""
    known = lambda x: x is not None and not math.isnan(x)
    out, y = [], None
    for i, x in enumerate(xs, 1):
        if i == first + n - 1:
            head = [v for v in xs[first - 1:i] if known(v)]
            y = sum(head) / len(head) if head else None
        elif i > first + n - 1 and y is not None and known(x):
            y = x if alpha >= 1 else y + alpha * (x - y)
        out.append(y)
    return out


@pytest.fixture(scope="module")
def patchy(spark):
    """One key with 6 000 rows, some inputs missing either way, among them a stretch of 300; a key whose seed is missing; a short and a NULL key."""
    rng = random.Random(11)
    data = {}
    for key, n in (("hot", 6000), ("late", 90), ("short", 2), (None, 40)):
        xs = [100 + rng.gauss(0, 5) for _ in range(n)]
        for i in rng.sample(range(n), n // 9):
            xs[i] = rng.choice([None, float("nan")])
        data[key] = xs
    data["hot"][2500:2800] = [None] * 300
    data["late"][:5] = [float("nan")] * 5
    rows = [(k, i + 1, x) for k, xs in data.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    return data, spark.createDataFrame(rows, "k string, row_no bigint, x double").cache()


@pytest.mark.parametrize("size", [64, 200, 512])
def test_averages_do_not_depend_on_chunks(patchy, size):
    data, df = patchy
    specs = {"a3": ("x", 3, 0.5, 1), "w3": ("x", 3, 1 / 3, 2), "a2000": ("x", 2000, 2 / 2001, 1), "one": ("x", 1, 1.0, 1), "fast": ("x", 2, 0.95, 5)}
    got = ordered.averages(df, KEYS, specs, size).toPandas()
    assert len(got) == len(df.toPandas()) and list(got.columns) == ["k", "row_no", "x", *specs]
    for k, xs in data.items():
        mine = got[got.k.isna() if k is None else got.k == k].sort_values("row_no")
        for name, (_, n, alpha, first) in specs.items():
            for g, w in zip(mine[name], average_loop(xs, n, alpha, first), strict=True):
                assert (w is None and pd.isna(g)) or math.isclose(g, w, rel_tol=1e-11), (k, name, size)


def test_shared_halo_has_the_same_rule(patchy):
    """The form that shares chunks gives the same values where its halo holds enough known inputs."""
    data, df = patchy
    for n, alpha in ((3, 0.5), (14, 1 / 14)):
        halo, size = ordered.chunk_plan([[alpha]], 350)
        seed = F.avg(ordered.known(F.col("x"))).over(ordered.chunk_window(KEYS).rowsBetween(-(n - 1), 0))
        cut = ordered.spread(df.filter("k = 'hot'"), halo, size)
        got = ordered.own_rows(cut.withColumn("y", ordered.recurrence(F.col("x"), seed, n, alpha, KEYS, halo, size))).orderBy("row_no").collect()
        for r, w in zip(got, average_loop(data["hot"], n, alpha, 1), strict=True):
            assert (w is None and r.y is None) or math.isclose(r.y, w, rel_tol=1e-9)


def test_a_key_may_span_batches():
    """Summaries of one key in several batches, and a key that begins inside a batch."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    place = [*range(1, 41), *range(1, 8)]
    a, b = rng.random(47), rng.normal(size=47)
    table = pa.RecordBatch.from_arrays([pa.array(place), pa.array(a), pa.array(b)], names=["_n", "_a0", "_b0"])
    got = [v for batch in ordered._affine_scan(iter([table.slice(0, 13), table.slice(13, 20), table.slice(33)]), 1) for v in batch.column("_c0").to_pylist()]
    y, want = 0.0, []
    for n, u, v in zip(place, a, b, strict=True):
        y = 0.0 if n == 1 else y
        want.append(y)
        y = v if n == 1 else u * y + v
    assert got[0] == 0 and np.allclose([g for g, n in zip(got, place) if n > 1], [w for w, n in zip(want, place) if n > 1])
