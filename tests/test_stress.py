"""The stress test decides on stretches between day starts; the full path of every permutation must agree."""

import random

import pytest
from pyspark.sql import functions as F

from candlewick.operators import mandate

KEY = ["trade_id"]


def _trades(spark, n=400):
    rng = random.Random(5)
    rows = [(None if a == 2 else f"a{a}", i, None if i % 37 == 0 else f"2024-03-{1 + rng.randrange(25):02d} {rng.randrange(24):02d}:15:00", rng.gauss(-2 if a else 3, 60), 0.1)
            for a in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "account string, trade_id long, at string, net_pnl double, lots double").withColumn("exit_time", F.to_timestamp("at")).drop("at")


@pytest.mark.parametrize("kind", ["static", "trailing"])
def test_stretches_agree_with_full_paths(spark, kind):
    m = {"drawdown_type": kind, "max_daily_loss_pct": 6.5, "max_overall_drawdown_pct": 13.0}
    t = _trades(spark)
    per, order, chunk = ["account", "perm"], ["_place", *KEY], F.floor(F.col("_place") * 7)
    told = t.withColumn("day", F.to_date("exit_time")).withColumn("_ident", F.col("trade_id").cast("string")).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(24))))
    rows = mandate._reshuffled(told, ["account"], KEY, F.lit(10.0), 1.5)
    points = mandate.trade_points(rows.drop("day"), per, order, chunk, 10000.0, m, F.col("_pnl"))
    paths = mandate.first_breach(points, per, order, m).collect()
    want = {(r.account, r.perm): not r.compliant for r in paths}
    told = told.withColumn("day", mandate.mandate_date(F.col("exit_time")))
    got = {(r.account, r.perm): r.failed for r in mandate._failing(mandate._reshuffled(told, ["account"], KEY, F.lit(10.0), 1.5), per, order, chunk, 10000.0, m).collect()}
    assert got == want and len(got) == 75
    assert {True, False} == set(want.values())
    out = {r.account: r for r in mandate.stress_test(t, ["account"], KEY, m, 10000.0, F.lit(10.0), 25, chunks=7).collect()}
    for account, row in out.items():
        failed = sorted((p.perm, p.breach) for p in paths if p.account == account and not p.compliant)
        assert row.breach_rate_pct == 4.0 * len(failed)
        assert row.first_breach == (failed[0][1] if failed else None)
    assert len(out) == 3


@pytest.mark.parametrize("kind", ["static", "trailing"])
def test_whole_keys_agree_with_fanned_ones(spark, kind, monkeypatch):
    m = {"drawdown_type": kind, "max_daily_loss_pct": 6.5, "max_overall_drawdown_pct": 13.0}
    t, run = _trades(spark), lambda t, **kw: {r.account: tuple(r)[1:] for r in mandate.stress_test(t, ["account"], KEY, m, 10000.0, F.lit(10.0), 25, **kw).collect()}
    want = run(t, chunks=7)
    with monkeypatch.context() as mp:
        # no permuted trade may be shuffled
        mp.setattr(mandate, "_stress_fanned", None)
        assert run(t) == want and len({rate for rate, _ in want.values()}) > 1
    # a key over a chunk goes the other way
    more = t.unionByName(_trades(spark, 5000).filter("account = 'a0'").withColumn("account", F.lit("big")))
    got = run(more)
    assert {k: v for k, v in got.items() if k != "big"} == want
    assert got == run(more, chunks=3)


def test_array_md5():
    import hashlib

    from candlewick.functions import hashing

    texts, numbers = [b"x" * n for n in range(140)], [0, 7, 10, 99, 100, 12345]
    seen = []
    for first, heads in hashing.uniform_parts("order", numbers, texts, 300):
        for n, row in zip(numbers[first:], heads):
            seen.append(n)
            assert [int(h) for h in row] == [int(hashlib.md5(f"order|{n}|".encode() + t).hexdigest()[:8], 16) for t in texts]
    assert seen == numbers


def test_array_md5_of_pairs():
    import hashlib

    import numpy as np

    from candlewick.functions import hashing

    numbers, mixed, alike = [0, 7, 10, 99, 100, 12345], [b"x" * n for n in range(140)], [b"y" * 45 + b"%04d" % n for n in range(9)]
    # the first words of a message, or whole blocks, may be the prefix's alone or the same in all texts
    for prefix, texts in [(p, t) for p in ("slip", "p" * 47, "p" * 50, "p" * 70) for t in (mixed, alike, alike[:1], [b"z"] * 3)]:
        want = [[int(hashlib.md5(f"{prefix}|{n}|".encode() + t).hexdigest()[:8], 16) for t in texts] for n in numbers]
        heads, rng = hashing.UniformHeads(prefix, texts), np.random.default_rng(3)
        assert [[int(h) for h in row] for _, block in heads.parts(numbers) for row in block] == want
        which, text = rng.integers(0, len(numbers), 400), rng.integers(0, len(texts), 400)
        assert heads.pairs(numbers, which, text, 150).tolist() == [want[i][j] for i, j in zip(which, text)]


def test_keys_over_a_chunk_stay_whole(spark, monkeypatch):
    m = {"drawdown_type": "static", "max_daily_loss_pct": 6.5, "max_overall_drawdown_pct": 13.0}
    t = _trades(spark, 5000).filter("account = 'a0'").withColumn("net_pnl", F.col("net_pnl") / 4)
    run = lambda **kw: [tuple(r) for r in mandate.stress_test(t, ["account"], KEY, m, 10000.0, F.lit(10.0), 25, **kw).collect()]
    want = run(chunks=3)
    monkeypatch.setattr(mandate, "_stress_fanned", None)
    assert run() == want and 0 < want[0][1] < 100


def test_slippage_stops_behind_the_last_risky_point(monkeypatch):
    import hashlib

    import numpy as np

    from candlewick.functions import hashing

    rng, n, m = np.random.default_rng(7), 600, {"drawdown_type": "static", "max_daily_loss_pct": 4.0, "max_overall_drawdown_pct": 8.0}
    ident, lots, pip = [b"t%d" % i for i in range(n)], rng.uniform(0.1, 5, n), np.full(n, 10.0)
    pnl, days, asked = rng.normal(360, 1400, n), rng.integers(0, 2000, n), []
    pairs = hashing.UniformHeads.pairs
    monkeypatch.setattr(hashing.UniformHeads, "pairs", lambda self, numbers, which, text, *rest: asked.append(len(which)) or pairs(self, numbers, which, text, *rest))
    count, rule = mandate._stress_one(ident, pnl, pip, lots, days, 100, 1.5, 100_000.0, m)

    head = lambda kind, p, t: int(hashlib.md5(f"{kind}|{p}|".encode() + t).hexdigest()[:8], 16) / 2**32
    rules = []
    for p in range(100):
        equity, start, latest, hit = 100_000.0, None, None, None
        for i in sorted(range(n), key=lambda i: (head("order", p, ident[i]), i)):
            equity += pnl[i] - head("slip", p, ident[i]) * 1.5 * 10 * lots[i]
            if latest is None or days[i] > latest:
                start, latest = equity, days[i]
            daily, dd = start > 0 and (start - equity) * 100 / start >= 4, (100_000 - equity) * 100 / 100_000 >= 8
            hit = hit or ("MANDATE_DAILY_LOSS_BREACH" if daily else "MANDATE_OVERALL_DD_BREACH" if dd else None)
        rules.append(hit)
    failed = [r for r in rules if r]
    assert (count, rule) == (len(failed), failed[0]) and 0 < count < 100
    assert sum(asked) < 0.2 * 100 * n
