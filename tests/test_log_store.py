"""The log store: equal answers with fewer files opened, incremental ingest, interrupted ingest."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.sources import log_store, logs

DAYS = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(12)]
LINES = [(f"/var/log/{system}_{d:%Y%m%d}.log", f"{d:%Y-%m-%d} {h:02d}:00:00,5 | {'ERROR' if h == 7 else 'INFO'} | {system} beat {h} of day {d:%j}")
         for system in ("engine", "trainer") for d in DAYS for h in range(0, 24, 7)]
LINES += [(f"engine_{DAYS[3]:%Y%m%d}.jsonl", '{"timestamp":"2024-01-04T03:00:00Z","event_type":"Füll_FAILURE","message":"größe 😀 needle"}'),
          ("engine_undated.log", "free text without a time, NEEDLE"), ("other.json", "{broken"), ("engine_odd [1]%2F.log", "   "), ("engine_odd [1]%2F.log", None)]


def at(s):
    return F.lit(s).cast("timestamp")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    lines = spark.createDataFrame(LINES, "path string, line string")
    log_store.add(lines, folder)
    return folder, lines


def rows(df):
    return sorted(map(str, df.collect()))


QUESTIONS = [{}, {"level": "error"}, {"system": "engine", "time_from": ("2024-01-05"), "time_to": "2024-01-06"}, {"text": "needle"},
             {"text": "ölle"}, {"text": "größe 😀 n"}, {"text": "ll_fail"}, {"text": "y"}, {"text": "nowhere at all"}, {"text": "beat 7", "level": "error", "time_from": "2024-01-11"}]


@pytest.mark.parametrize("ask", QUESTIONS)
def test_answers_are_those_of_all_lines(spark, store, ask):
    (folder, lines), now = store, at("2024-02-01")
    ask = {k: at(v) if k.startswith("time") else v for k, v in ask.items()}
    assert rows(log_store.query(spark, folder, now=now, **ask)) == rows(logs.query_entries(logs.parse_entries(lines, now), **ask))


def opened(spark, folder, **ask):
    found = log_store.open_lines(spark, folder, log_store.candidates(spark, folder, **ask)).inputFiles()
    return sum("/lines/" in f for f in found)


def test_only_candidate_files_are_opened(spark, store):
    folder, _ = store
    all_files = log_store.files(spark, folder).count()
    assert all_files >= 28
    assert opened(spark, folder, text="of day 005") == 2
    assert opened(spark, folder, text="of day 005", system="trainer") == 1
    assert opened(spark, folder, text="NEEDLE") == 2
    assert opened(spark, folder, text="nowhere at all") == 0
    # two days, and the file whose entry has no time
    assert opened(spark, folder, system="engine", time_from=at("2024-01-05"), time_to=at("2024-01-06 23:00:00")) == 3


def test_many_parts_are_joined_instead_of_named(spark, store):
    folder, _ = store
    some = log_store.candidates(spark, folder, text="of day 00")
    assert rows(log_store.open_lines(spark, folder, some, named=3)) == rows(log_store.open_lines(spark, folder, some))


def test_manifest(spark, store):
    folder, _ = store
    by_path = {r.path: r for r in log_store.files(spark, folder).collect()}
    odd, free, day = by_path["engine_odd [1]%2F.log"], by_path["engine_undated.log"], by_path["/var/log/engine_20240105.log"]
    assert (odd.lines, odd.entries, odd.timeless) == (2, 0, 0) and (free.entries, free.timeless, free.first) == (1, 1, None)
    assert (day.entries, day.first, day.last) == (4, datetime(2024, 1, 5, 0, 0, 0, 500000), datetime(2024, 1, 5, 21, 0, 0, 500000))


def test_words_of_the_filter_are_pushed_to_the_scan(spark, store):
    folder, _ = store
    plan = log_store.candidates(spark, folder, text="needle")._jdf.queryExecution().executedPlan().toString()
    assert "In(word" in plan and "CartesianProduct" not in plan


def test_ingest_again_and_after_an_interruption(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    a = spark.createDataFrame([("engine_1.log", "alpha one"), ("engine_1.log", "alpha two")], "path string, line string")
    b = a.unionByName(spark.createDataFrame([("engine_2.log", "beta one")], a.schema))
    assert rows(log_store.query(spark, folder, text="alpha")) == []
    with monkeypatch.context() as m:
        m.setattr(log_store, "_words", lambda *_: 1 / 0)  # the lines are written, the index is not
        with pytest.raises(ZeroDivisionError):
            log_store.add(a, folder)
    assert log_store.query(spark, folder, text="alpha").count() == 0
    for _ in range(2):
        log_store.add(a, folder)
        assert log_store.query(spark, folder).count() == 2
    for _ in range(2):
        log_store.add(b, folder)
        assert log_store.query(spark, folder).count() == 3
    log_store.add(a.limit(0), folder)
    assert log_store.query(spark, folder, text="beta").count() == 1


def test_grams_of_odd_texts(spark):
    texts = [("p", "User 1 did"), ("p", "user 1 did"), ("q", "user 1 did"), ("p", ""), ("q", "ab"), ("p", "x\U0001F600yz\U0001F600"), ("q", "ÄÖü\x00\n"), ("p", None)]
    df = spark.createDataFrame(texts * 50, "part string, text string").select("part", F.coalesce("text", F.lit("")).alias("text")).coalesce(1)
    want = {(p, t.lower()[i:i + 3]) for p, t in texts if t for i in range(len(t) - 2)}
    got = [tuple(r) for r in log_store._grams(df).collect()]
    assert set(got) == want and len(got) == len(want)
