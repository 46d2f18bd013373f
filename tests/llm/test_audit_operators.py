"""Exact duplicates, filter audit and whitening against brute force."""

import hashlib
import math
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candlewick.llm import exact_dedup, filter_audit, whitening


def want_classes(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def got_classes(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.crc32(t.cast("binary")) % 3, lambda t: F.lit(1)])
@pytest.mark.parametrize("common", [1, 16384])
def test_exact_duplicates(odd, small, monkeypatch, digest, common):
    """Also with digests that different texts share, and with no class that is broadcast."""
    monkeypatch.setattr(exact_dedup, "COMMON", common)
    docs = odd.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    assert got_classes(exact_dedup.exact_duplicates(docs, digest=digest)) == want_classes(rows)


def test_exact_duplicates_cases(spark, odd, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0
    assert got_classes(exact_dedup.exact_duplicates(odd)) == want_classes([tuple(r) for r in odd.select("doc_id", "text").collect()])
    folded = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string"), normalise=F.lower)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in folded.collect()} == {(1, 2, False), (2, 2, True)}
    once = exact_dedup.deduplicated(odd)
    assert once.columns == odd.columns
    texts = [r["text"] or "" for r in once.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r["text"] or "" for r in odd.select("text").collect()}


def test_exact_duplicates_stays_in_the_engine(odd):
    plan = exact_dedup.exact_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def want_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None and i <= first.get(t or "", i):
            first[t or ""] = i
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and first[t] < i}
        parts[p or ""].append(({k for k, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out = set()
    for p, rows in parts.items():
        made, shapley = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                made.append((f, (p, "".join(order), k + 1, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows),
                                 sum(r[1] for r in gone), sum(r[2] for r in gone))))
        out |= {(*m, shapley[f]) for f, m in made}
    return out


def test_filter_audit(spark, odd, empty, small):
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    docs = odd.select("doc_id", "text", "source", "n_words").unionByName(small.select("doc_id", "text", "source", F.lit("x").alias("n_words")))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(5, 1, None), (5, 0, 1), (None, 1, 1), (6, None, None), (999999, 1, 1)], "doc_id long, quality int, toxic int").select(
        *[F.col(c).cast(t) for c, t in labels.dtypes]))
    got = filter_audit.audit(docs, labels.withColumn("source", F.lit("clash"))).collect()
    want = want_audit([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert len(got) == len(want) and {tuple(r[c] for c in cols) for r in got} == want
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(odd, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


ids = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(ids, max_size=5), ids, ids)
def test_galloping(lists, a, b):
    assert filter_audit.union(lists) == sorted(set().union(*lists))
    assert filter_audit.difference(a, b) == sorted(set(a) - set(b))


def want_whitening(rows):
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[k] for _, v in x) for k in range(d)]
    z = [[Fraction(n * v[k] - s[k], n) for k in range(d)] for _, v in x]
    cov = np.array([[float(sum(r[i] * r[j] for r in z) / n) for j in range(d)] for i in range(d)])
    return n, [(i, sum((n * v[k] - s[k]) ** 2 for k in range(d))) for i, v in x], np.array([[float(c) for c in r] for r in z]), cov


def check_whitening(got, rows, components=32):
    n, deviations, z, cov = want_whitening(rows)
    e = np.sort(np.linalg.eigvalsh(cov))[::-1]
    k = min(components, len(e))
    by = defaultdict(list)
    for r in got:
        assert r["n"] == n and math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-6) and r["identity_error"] < 1e-6
        by[r["vec_id"]].append(r)
    assert len(got) == n * k
    assert sorted(((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1), key=repr) == sorted(deviations, key=repr)
    order = {i: at for at, (i, _) in enumerate(deviations)}
    w = np.zeros((n, k))
    for i, rs in by.items():
        for r in rs:
            w[order[i], r["component"] - 1] = r["whitened"]
    if len(by) == n:
        assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-8)
        assert np.allclose(cov @ (z.T @ w / n), (z.T @ w / n) * e[:k], atol=1e-6 * e[0])  # the projections come from unit eigenvectors
        assert np.allclose(np.linalg.norm(z.T @ w / n, axis=0), np.sqrt(e[:k]))
    return w


def test_whitening(spark):
    rng = np.random.default_rng(3)
    sound = [(i, [float(x) for x in rng.normal(size=5) * [1, 3, 0.2, 1, 7] + [0, 100, -50, 0, 0.1]]) for i in range(120)]
    bad = [(200, None), (201, []), (202, [None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [1.0, float("inf"), 1.0, 1.0, 1.0]), (205, [1.0]), (206, [1.0] * 6)]
    df = spark.createDataFrame(sound + bad, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash")).withColumn("v", F.lit(1))
    out = whitening.whitened(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(out.collect(), sound)
    assert whitening.whitened(df, components=2).count() == 240
    odd_ids = [(None, sound[0][1]), (None, sound[1][1]), (7, sound[2][1]), *[(i, v) for i, v in sound[3:]]]
    assert whitening.whitened(spark.createDataFrame(odd_ids, "vec_id long, embedding array<double>")).where("vec_id IS NULL").count() == 10


def test_whitening_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check_whitening(whitening.whitened(df).collect(), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_whitening_without_rows_or_spread(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], schema)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], schema)).collect()
    assert len(flat) == 4 and {r["component"] for r in flat} == {1} and {r["explained"] for r in flat} == {1.0}


def test_whitening_stays_exact(spark):
    """Entries beyond 32 bits: sums of squares leave 64 bits, the covariance stays exact."""
    big = [(i, [1e9 * (i % 7), 1e9 + i, 3e8 * i]) for i in range(40)]
    w = whitening.fit(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    assert np.allclose(w.covariance, want_whitening(big)[3], rtol=1e-14)
    with pytest.raises(Exception, match="2\\^56"):
        whitening.whitened(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()
    huge = whitening.whitened(spark.createDataFrame(big, "vec_id long, embedding array<double>")).where("deviation IS NULL")
    assert huge.count() > 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=20))
def test_sums_and_polarisation(rows):
    x = np.array(rows, dtype=np.int64)
    n, s = len(rows), [sum(r[k] for r in rows) for k in range(3)]
    m = [(2 * a + n) // (2 * n) for a in s]
    z = x - np.array(m)
    bound = 4 * int(np.abs(z).max()) ** 2
    squares = whitening._sums([(whitening._square(z if bound < whitening.SAFE else z.astype(object)), bound * n)], 6)
    got = whitening.covariance_of(n, [a - n * b for a, b in zip(s, m, strict=True)], squares)
    want = [[float((Fraction(sum(r[i] * r[j] for r in rows), n) - Fraction(s[i] * s[j], n * n))) for j in range(3)] for i in range(3)]
    assert got.tolist() == want
    assert whitening._emit(squares).column("s").to_pylist() == squares and isinstance(whitening._emit(squares), pa.RecordBatch)
