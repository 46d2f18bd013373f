import corpus_pipeline
from tests.llm.test_corpus_operators import near_loop, texts_of
from tests.llm.test_text_operators import contaminated_loop, pii_loop, quality_loop

from candlewick.llm import decontaminate, quality


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs.columns
    seen = {}
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, docs, sf).cache()
        seen[name] = ({r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}, out.count())
        if name != "mix_sources":
            assert out.columns == start and out.dtypes == docs.dtypes
        docs = out
    old, new, n = seen["quality_rules"]
    assert n == len(new) < len(old)
    for i, r in old.items():
        words, chars, symbols, dup, repeated = quality_loop(r["text"])
        if words < 10 or 5 * repeated > words or 10 * symbols > words:
            assert i not in new
    bits = {r["doc_id"]: r["fail_bits"] for r in quality.ledger(spark.createDataFrame(list(old.values()), start)).collect()}
    assert set(new) == {i for i, b in bits.items() if b == 0}
    old, new, _ = seen["near_dedup"]
    assert set(new) == {i for i, _, _, k in near_loop([(i, r["text"]) for i, r in old.items()]) if k} and all(new[i] == old[i] for i in new)
    old, new, _ = seen["decontamination"]
    items = [(r["item_id"], [w.decode() for w in decontaminate.words_of(r["text"])]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(new) == {i for i, r in old.items() if not contaminated_loop(r["text"], items)[1]} and len(new) < len(old)
    old, new, _ = seen["personal_data"]
    assert set(new) == set(old)
    for i, r in old.items():
        assert (new[i]["text"] == r["text"]) or pii_loop(r["text"]) or not pii_loop(new[i]["text"])
        assert not pii_loop(new[i]["text"])
    old, new, _ = seen["mix_sources"]
    assert all(0 < r["taken"] <= 3 * r["size"] and r["text"] == old[i]["text"] for i, r in new.items())
    order = [r["first_slot"] for r in out.collect()]
    assert order == sorted(order) and len(set(order)) > 3
    final = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert final == {i: r["taken"] for i, r in new.items()}


def test_odd_rows_pass_through(spark, odd, empty, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, None), (None, "one")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs in (odd, empty):
        for name, fn in corpus_pipeline.STAGES:
            docs = fn(spark, docs, sf)
            if name != "mix_sources":
                assert docs.columns == odd.columns
        docs.collect()


def test_entry_has_all_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert texts_of
