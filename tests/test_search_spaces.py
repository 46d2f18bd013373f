"""Which templates, spaces and pairs the registered searches evaluate."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from candlewick.operators import grid as g
from candlewick.operators import walkforward as wf
from candlewick.plans import QUERIES
from candlewick.plans import grid_queries as gq


@pytest.fixture
def searched(spark, monkeypatch):
    """The (template, space, exit template) of every search; the searches themselves are replaced by literals."""
    seen = []
    scores = spark.createDataFrame([("A", "MAIN", 1, 0.5)], "symbol string, span_id string, params_id bigint, score double")

    def evaluation(i, specs, template, space, exit_template=None):
        seen.append((template, space, exit_template))
        return SimpleNamespace(template=template, scores=lambda *_: scores)

    def walk_forward(i, specs, template, space, *_):
        seen.append((template, space, None))
        return spark.createDataFrame([("A", 1, 1, 10, 0.5)], "symbol string, window_num int, params_id bigint, is_trades bigint, is_composite_score double")

    def filter_test(ev, candidates, spans):
        extra = {"atr_ratio_min": F.lit(None).cast("double"), "atr_ratio_max": F.lit(None).cast("double"), "applied": F.array().cast("array<string>"), "score": F.lit(0.0)}
        return candidates.withColumns(extra), None

    bars = spark.createDataFrame([("A", 0)], "symbol string, row_no bigint").withColumns({"ts": F.lit("2020-01-01").cast("timestamp")} | {c: F.lit(1.0) for c in ("open", "high", "low", "close")})
    monkeypatch.setattr(gq, "daily", lambda spark, d: bars)
    monkeypatch.setattr(gq, "_halves", lambda i: spark.createDataFrame([("A", "MAIN")], "symbol string, span_id string"))
    for name, fn in (("Evaluation", evaluation), ("walk_forward", walk_forward), ("filter_test", filter_test)):
        monkeypatch.setattr(wf, name, fn)
    return seen


def test_filter_test_searches_the_full_grid_of_every_template(spark, searched):
    out = QUERIES["wf_filter_test"](spark, "").collect()
    assert searched == [(t, space, None) for t, space in g.SPACES.items()]
    assert {r.template for r in out} == set(g.SPACES)


def test_combination_test_searches_every_pair_on_full_grids(spark, searched):
    out = QUERIES["wf_combination_test"](spark, "").collect()
    assert {(t, x) for t, _, x in searched if x} == set(g.COMBINATIONS) == {(r.entry_template, r.exit_template) for r in out}
    assert all(space == g.SPACES[t] for t, space, _ in searched)
    assert {t for t, _, x in searched if x is None} == set(g.SPACES)


def test_leak_audit_searches_the_full_grid(spark, searched):
    assert QUERIES["wf_leak_audit"](spark, "").count() == 1
    assert searched == [("ma_crossover", g.SPACES["ma_crossover"], None)] * 3


def test_every_template_has_a_walk_forward_query():
    assert {"wf_walk_forward", "wf_walk_forward_donchian", "wf_walk_forward_hybrid", "wf_walk_forward_rsi"} <= set(QUERIES)
