"""Parameter sets that differ in their guards only share one single-position path."""

from pyspark.sql import functions as F
from test_simulation import CAPITAL, indexed, specs  # noqa: F401

from candlewick.functions.staging import stage
from candlewick.operators import grid as g
from candlewick.operators import indicators as ind
from candlewick.operators import paths, trades

SPACE = {"rsi_oversold": [48], "rsi_overbought": [52], "exit_on_midline": [False], "sl_atr_multiple": [0.5], "tp_rr_ratio": [1.5], "adx_threshold": [0, 20],
         "cooldown_requires_midline": [True, False], "daily_loss_halt_pct": [0.0, 1.0, 2.0]}


def test_guards_share_paths(spark, indexed, specs, monkeypatch):  # noqa: F811
    name, handed = "rsi_reversion", []
    one_position = paths.one_position
    combos, exits = g.entry_combos(name, SPACE), g.exit_combos(SPACE, name)
    feats = stage(g.grid_features(indexed, name, combos))
    out = stage(g.outcomes(g.entry_signals(feats, name, combos), feats, specs, name, exits, noise=False, combos=combos))
    last = indexed.agg(F.max("row_no")).first()[0]
    spans = spark.createDataFrame([("A", "MAIN", 1, last + 1)], "symbol string, span_id string, start_no bigint, end_no bigint")
    sets = g.parameter_grid(spark, name, SPACE)
    # as the filter test gives them: per symbol, named by text, with settings that are NULL
    scoped = sets.withColumns({"symbol": F.lit("A"), "params_id": F.concat(F.col("params_id").cast("string"), F.lit("|-")), "atr_ratio_min": F.lit(None).cast("double"),
                               "allowed_sessions": F.lit(None).cast("array<string>")})
    monkeypatch.setattr(paths, "one_position", lambda cands, keys, *a: handed.append(cands.select(*keys).distinct().count()) or one_position(cands, keys, *a))

    def trades_of(some):
        got = {}
        for r in g.pick_trades(out, feats, specs, name, some, spans, warmup=0).collect():
            got.setdefault(str(r.params_id).split("|")[0], []).append((r.signal_no, r.exit_no, round(r.net_pnl, 6)))
        return {k: sorted(v) for k, v in got.items()}

    got = trades_of(sets)
    assert trades_of(scoped) == got
    assert handed == [2, 2]  # twelve sets, two filters of the signals
    one = stage(ind.with_warmup_defaults(ind.features(indexed)))
    wanted = set()
    for p in sets.filter("adx_threshold = 0").collect():
        want = sorted((r.signal_no, r.exit_no, round(r.net_pnl, 6)) for r in trades.simulate(one, specs, name, p.asDict(), CAPITAL, noise=False).collect())
        assert got.get(str(p.params_id), []) == want
        wanted.add(tuple(want))
    assert len(wanted) > 3
