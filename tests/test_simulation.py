"""Sequential rules against a candle-by-candle loop on a small random walk."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.functions.staging import stage
from candlewick.operators import grid as g
from candlewick.operators import indicators as ind
from candlewick.operators import paths, signals, trades
from candlewick.operators import walkforward as wf
from candlewick.schemas import INSTRUMENT

SPEC = [("A", 5, 0.001, 100.0, 0.001, 0.1, 0.01, 0.01, 50.0, 0, 12, -1.0, 0.5)]
CAPITAL = 10_000.0


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(42)
    price, rows = 100.0, []
    for i in range(420):
        o = price
        price = max(5.0, price + rng.gauss(0, 1.2))
        hi, lo = max(o, price) + abs(rng.gauss(0, 0.6)), min(o, price) - abs(rng.gauss(0, 0.6))
        rows.append(("A", "H1", datetime(2024, 1, 1) + timedelta(hours=i), o, hi, lo, price, float(rng.randint(50, 150)), i + 1))
    return spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double, row_no bigint").cache()


@pytest.fixture(scope="module")
def feats(indexed):
    return stage(ind.with_warmup_defaults(ind.features(indexed, {"channel_period": 10, "exit_period": 5})))


@pytest.fixture(scope="module")
def specs(spark):
    return spark.createDataFrame(SPEC, INSTRUMENT)


def candle_loop(feats, specs, name, params, halt=0.0, cool=False, start=0, end=None):
    """One account, bar by bar: pending entries and exits at the open, stops inside the bar, decisions at the close."""
    sig = signals.with_exit_flags(signals.with_signals(feats, name, params, reasons=False), name, params)
    bars = sig.withColumn("crossed", signals.midline_crossed(params, name)).orderBy("row_no").collect()
    # every possible fill and its P&L pieces come from the same columns as the library's
    fills = {r.signal_no: r for r in trades.next_bar_fills(sig, feats, specs, capital=CAPITAL).collect()}
    bars = [b for b in bars if b.row_no > start and (end is None or b.row_no <= end)]
    pos = pend = pend_exit = None
    out, last_trade, midline, day, day_loss = [], None, False, None, 0.0

    def close(reason, price, bar):
        nonlocal pos, last_trade, midline, day, day_loss
        t = (pos.signal_no, bar.row_no, pos.direction, reason, price)
        out.append(t)
        net = pnl(pos, price, bar)
        d = bar.ts.date()
        day_loss = (day_loss if day == d else 0.0) + net
        day = d
        last_trade, midline, pos = (pos.direction, net), False, None

    def pnl(p, price, bar):
        n, mark = 0, p.entry_time.replace(hour=21, minute=0)
        if mark <= p.entry_time:
            mark += timedelta(days=1)
        while mark < bar.ts:
            n += {2: 3, 5: 0, 6: 0}.get(mark.weekday(), 1)
            mark += timedelta(days=1)
        sgn = 1 if p.direction == "BUY" else -1
        return sgn * (price - p.entry_price) / 0.001 * p.lots * 0.1 - 7 * p.lots + (-1.0 if sgn > 0 else 0.5) * p.lots * n

    for b in bars:
        if pend_exit and pos:
            close("EXIT_SIGNAL", b.open, b)
        pend_exit = None
        if pend is not None and pos is None:
            pos = fills.get(pend)
        pend = None
        if pos:
            buy = pos.direction == "BUY"
            if (b.low <= pos.sl_price) if buy else (b.high >= pos.sl_price):
                close("SL_HIT", min(pos.sl_price, b.open) if buy else max(pos.sl_price, b.open), b)
            elif (b.high >= pos.tp_price) if buy else (b.low <= pos.tp_price):
                close("TP_HIT", pos.tp_price, b)
        if b.session == "DEAD_ZONE":
            continue
        if pos and (b.buy_exit if pos.direction == "BUY" else b.sell_exit):
            pend_exit = True
        if pos is None:
            halted = halt > 0 and day == b.ts.date() and day_loss / CAPITAL * 100 <= -halt
            if halted:
                continue
            midline = midline or b.crossed
            blocked = cool and last_trade and last_trade[1] < 0 and not midline and b.signal == last_trade[0]
            if b.signal != "HOLD" and not blocked:
                pend = b.row_no
    if pos:
        close("END_OF_DATA", bars[-1].close, bars[-1])
    return out


@pytest.mark.parametrize(("name", "params"), [
    ("donchian_breakout", {"sl_atr_multiple": 1.0, "tp_rr_ratio": 1.5}),
    ("rsi_reversion", {"rsi_oversold": 45, "rsi_overbought": 55, "sl_atr_multiple": 1.0}),
    ("combo_donchian_breakout__rsi_reversion", {"sl_atr_multiple": 2.0}),
    ("hybrid_confluence", {"adx_threshold": 0, "rsi_oversold": 48, "rsi_overbought": 52}),
    ("ma_crossover", {"exit_on_opposite_crossover": True})])
def test_simulate_equals_candle_loop(feats, specs, name, params):
    got = trades.simulate(feats, specs, name, params, CAPITAL, fan_out=4).orderBy("signal_no").collect()
    want = candle_loop(feats, specs, name, params)
    assert len(want) >= 5
    assert [(t.signal_no, t.exit_no, t.direction, t.close_reason) for t in got] == [w[:4] for w in want]
    assert [t.exit_price for t in got] == pytest.approx([w[4] for w in want])


def test_guards_are_columns_of_the_path(feats, specs):
    """Day's realised low and lost side of every taken trade against a loop, and what the guards leave."""
    params = {"rsi_oversold": 48, "rsi_overbought": 52, "exit_on_midline": False, "sl_atr_multiple": 0.5, "tp_rr_ratio": 1.5}
    taken = stage(trades.simulate(feats, specs, "rsi_reversion", params, CAPITAL))
    crossed = signals.midline_crossed(params, "rsi_reversion")
    crossings = [r.row_no for r in feats.filter(crossed).collect()]
    got = {r.signal_no: r for r in paths.guard_columns(trades.with_guard_inputs(taken, feats, crossed), ["symbol"]).collect()}
    rows = taken.orderBy("signal_no").collect()
    assert len(got) == len(rows) > 20
    kept = {(h, c): [] for h in (0.0, 1.0) for c in (False, True)}
    for i, t in enumerate(rows):
        total, low = 0.0, None
        for x in rows[:i]:
            if x.exit_time.date() == t.signal_time.date():
                total += x.net_pnl
                low = total if low is None else min(low, total)
        last = rows[i - 1] if i else None
        lost = bool(last) and last.net_pnl < 0 and last.direction == t.direction and not any(last.exit_no <= c <= t.signal_no for c in crossings)
        assert got[t.signal_no].side_lost == lost and (low is None) == (got[t.signal_no].day_low is None)
        assert low is None or got[t.signal_no].day_low == pytest.approx(low)
        for h, c in kept:
            if not (h > 0 and low is not None and low / CAPITAL * 100 <= -h) and not (c and lost):
                kept[h, c].append(t.signal_no)
    assert len({tuple(k) for k in kept.values()}) >= 3
    for (h, c), want in kept.items():
        p = {**params, "daily_loss_halt_pct": h, "cooldown_requires_midline": c}
        assert [t.signal_no for t in trades.simulate(feats, specs, "rsi_reversion", p, CAPITAL).orderBy("signal_no").collect()] == want


def test_one_position_long_overlapping_run(spark):
    """A hot key whose candidates all overlap, spread over several chunks of the carry."""
    rng = random.Random(3)
    rows = [("k", i, i + rng.randint(1, 9)) for i in range(0, 9000, 3)]
    got = [r.signal_no for r in paths.one_position(spark.createDataFrame(rows, "k string, signal_no bigint, exit_no bigint"), ["k"]).orderBy("signal_no").collect()]
    free, want = -1, []
    for _, s, x in rows:
        if s >= free:
            want.append(s)
            free = x
    assert got == want


SPACE = {"fast_ma_period": [3, 5], "slow_ma_period": [8, 12], "ma_type": ["SMA"], "sl_atr_multiple": [1.0, 2.0], "tp_rr_ratio": [1.5], "adx_threshold": [0, 20]}


def test_factored_grid_equals_single_runs(spark, indexed, specs):
    combos = g.entry_combos("ma_crossover", SPACE)
    feats = stage(g.grid_features(indexed, "ma_crossover", combos))
    sets = g.parameter_grid(spark, "ma_crossover", SPACE).withColumn("use_exit", F.lit(False))
    out = stage(g.outcomes(g.entry_signals(feats, "ma_crossover", combos), feats, specs, "ma_crossover", [(s, 1.5, False) for s in (1.0, 2.0)]))
    ts = lambda n: datetime(2024, 1, 1) + timedelta(hours=n - 1)
    spans = spark.createDataFrame([("A", "1:OPT", 60, 260, ts(60), ts(260)), ("A", "1:TEST", 260, 400, ts(260), ts(400))],
                                  "symbol string, span_id string, start_no bigint, end_no bigint, start timestamp, end timestamp")
    got = {}
    for r in g.pick_trades(out, feats, specs, "ma_crossover", sets, spans, warmup=0).collect():
        got.setdefault((r.span_id, r.params_id), []).append((r.signal_no, r.exit_no, r.direction, r.close_reason))
    total = 0
    for p in sets.collect():
        one = stage(ind.with_warmup_defaults(ind.features(indexed, p.asDict())))
        for span, lo, hi in (("1:OPT", 60, 260), ("1:TEST", 260, 400)):
            want = [w[:4] for w in candle_loop(one, specs, "ma_crossover", p.asDict(), start=lo - 1, end=hi - 1)]
            assert sorted(got.get((span, p.params_id), [])) == want
            total += len(want)
    assert total > 50


@pytest.mark.parametrize(("name", "space"), [
    ("ma_crossover", {"fast_ma_period": [3], "slow_ma_period": [9], "ma_type": ["SMA", "EMA"], "exit_on_opposite_crossover": [False, True], "risk_per_trade_pct": [0.5, 2.0], "sl_atr_multiple": [1.0]}),
    ("rsi_reversion", {"rsi_period": [5, 14], "rsi_oversold": [45], "rsi_overbought": [55], "exit_on_midline": [True, False], "sl_atr_multiple": [1.0]}),
    ("donchian_breakout", {"channel_period": [12], "exit_period": [3, 5], "exit_on_opposite_crossover": [False, True], "sl_atr_multiple": [2.0]}),
    ("hybrid_confluence", {"slow_ma_period": [9], "ma_type": ["EMA"], "rsi_period": [2, 7], "rsi_oversold": [48], "rsi_overbought": [52], "sl_atr_multiple": [1.0]})])
def test_every_axis_of_the_grid_counts(spark, indexed, specs, name, space):
    """Each set of the factored grid has the trades and lots of a run of that set alone."""
    space = {**space, "tp_rr_ratio": [1.5], "adx_threshold": [0]}
    g.check_space(name, space)
    combos, exits = g.entry_combos(name, space), g.exit_combos(space, name)
    feats = stage(g.grid_features(indexed, name, combos, [e[4] for e in exits]))
    sets = g.parameter_grid(spark, name, space)
    out = stage(g.outcomes(g.entry_signals(feats, name, combos), feats, specs, name, exits, noise=False, combos=combos))
    last = indexed.agg(F.max("row_no")).first()[0]
    spans = spark.createDataFrame([("A", "MAIN", 1, last + 1)], "symbol string, span_id string, start_no bigint, end_no bigint")
    got = {}
    for r in g.pick_trades(out, feats, specs, name, sets, spans, warmup=0).collect():
        got.setdefault(r.params_id, []).append((r.signal_no, r.exit_no, r.direction, r.close_reason, round(r.lots, 6), round(r.net_pnl, 6)))
    seen = set()
    for p in sets.collect():
        one = stage(ind.with_warmup_defaults(ind.features(indexed, p.asDict())))
        want = [(r.signal_no, r.exit_no, r.direction, r.close_reason, round(r.lots, 6), round(r.net_pnl, 6))
                for r in trades.simulate(one, specs, name, p.asDict(), noise=False).collect()]
        assert sorted(got.get(p.params_id, [])) == sorted(want)
        seen.add(tuple(sorted(want)))
    assert len(seen) >= 2 and max(map(len, seen)) > 5


def test_unknown_axes_raise(spark, indexed, specs):
    space = {**SPACE, "trailing_stop": [1]}
    with pytest.raises(ValueError, match="trailing_stop"):
        wf.Evaluation(indexed, specs, "ma_crossover", space)
    with pytest.raises(ValueError, match="rsi_period"):
        g.check_space("donchian_breakout", {"rsi_period": [14]})


def test_best_per_span_first_wins_ties(spark):
    s = spark.createDataFrame([("A", "1", 3, 0.5), ("A", "1", 2, 0.5), ("A", "1", 1, 0.1), ("A", "2", 1, 0.0)], "symbol string, span_id string, params_id bigint, score double")
    assert [(r.span_id, r.params_id) for r in g.best_per_span(s).collect()] == [("1", 2)]


def test_windows_count_from_origin(spark):
    b = spark.createDataFrame([("A", datetime(2020, 1, 31)), ("A", datetime(2021, 2, 1))], "symbol string, ts timestamp")
    w = wf.build_windows(b, 6, 2).orderBy("window_num").collect()
    assert [x.test_start for x in w] == [datetime(2020, 7, 31), datetime(2020, 9, 30), datetime(2020, 11, 30)]
    assert w[0].opt_start == datetime(2020, 1, 31) and w[2].test_end == datetime(2021, 1, 31)


def test_filter_test_keeps_only_real_improvements(spark, indexed, specs):
    ev = wf.Evaluation(indexed, specs, "ma_crossover", SPACE)
    ts = lambda n: datetime(2024, 1, 1) + timedelta(hours=n - 1)
    spans = spark.createDataFrame([("A", "MAIN", 1, 300, ts(1), ts(300)), ("A", "HELD_OUT", 300, 421, ts(300), ts(420))],
                                  "symbol string, span_id string, start_no bigint, end_no bigint, start timestamp, end timestamp")
    sets = g.parameter_grid(spark, "ma_crossover", SPACE).filter("adx_threshold = 0").withColumn("symbol", F.lit("A"))
    rates = spark.createDataFrame([("volatility", 0.1)], "filter_name string, improvement_rate double")
    out, log = wf.filter_test(ev, sets, spans, rates)
    rows, tried = out.collect(), log.collect()
    assert len(rows) == sets.count() == len({r.params_id for r in rows})
    assert {t.filter_name for t in tried} == {"session", "adx_trend"}  # the filter that rarely helped is skipped
    for r in rows:
        mine = [t for t in tried if t.params_id == r.params_id]
        assert r.applied == [t.setting for t in mine if t.improved] and len(r.applied) <= 2
        base = r.score - sum(t.delta for t in mine if t.improved)
        for t in mine:
            assert t.improved == (base + t.delta > base * 1.05 + 1e-12)
            base += t.delta if t.improved else 0


def test_combination_must_beat_both_parents(spark):
    f = lambda rows: spark.createDataFrame(rows, "symbol string, params_id bigint, score double")
    out = wf.combination_test(f([("A", 1, 0.5), ("A", 2, 0.2)]), f([("A", 7, 0.4)]), f([("A", 1, 0.52), ("A", 2, 0.43)]))
    assert {(r.entry_id, r.beats_parents) for r in out.collect()} == {(1, False), (2, True)}
