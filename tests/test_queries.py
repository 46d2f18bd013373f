"""A sample of registered queries against DuckDB, and what their plans may contain."""

import duckdb
import pytest
from check_oracle import TABLES, compare

from candlewick import bindings as b
from candlewick.operators import indicators as ind
from candlewick.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["flagship_ma_signals", "bars_from_ticks", "bars_slice_windows", "quality_gaps", "calendar_swap_nights", "indicator_macd", "signal_checklist",
          "trade_lot_sizing", "trade_as_of_bar", "metrics_summary", "mandate_first_breach", "wf_windows_rolling", "history_region_statistics",
          "hash_config", "log_entries", "monitor_rolling", "bench_upsert"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    verdict, rows = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert verdict == "ok" and rows > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["flagship_ma_signals", "metrics_summary", "indicator_features", "quality_check_all", "monitor_rolling", "wf_summary"])
def test_plan_has_no_cartesian_or_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "FlatMapGroupsInPandas", "SinglePartition"):
        assert bad not in text


def test_features_sort_each_chunk_once(spark):
    text = plan(ind.features(b.indexed_bars(spark, SF)))
    assert text.count("hashpartitioning(symbol") <= 8
    assert sum("_chunk" in line and "Sort [" in line and "row_no" in line for line in text.splitlines()) == 1


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["calendar_elapsed_years"](spark, SF))
    schema = text.split("ReadSchema:")[1].splitlines()[0]
    assert "l_extendedprice" not in schema and "l_shipdate" in schema


def test_names_are_sound():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
