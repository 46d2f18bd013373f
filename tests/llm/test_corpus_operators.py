"""Operators over the whole corpus against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.conftest import rows_of

from candlewick.llm import language_model, mixing, near_duplicates, packed, suffix_dedup, warc
from candlewick.llm.components import components


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def lm_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) + [None]


def test_language_model(odd, small, empty):
    docs = odd.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    rows = texts_of(docs)
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5

    def counts(keep):
        one, two = Counter(), Counter()
        begin = 0
        for i, t in rows:
            if keep(fold(i)):
                ws = lm_tokens(t)
                one.update(ws)
                two.update(zip(["<begin>", *ws], ws, strict=False))
                begin += 1
        return one, two, {**one, "<begin>": begin}

    one, two, ctx = counts(lambda f: f != 1)
    rest, rest2, rest_ctx = counts(lambda f: f not in (0, 1))
    n, v, n_rest, v_rest = sum(one.values()), len(one), sum(rest.values()), len(rest)
    table = defaultdict(lambda: [0, 0.0, 0.0])
    for i, t in rows:
        if fold(i) == 0:
            ws = lm_tokens(t)
            for a, b in zip(["<begin>", *ws], ws, strict=False):
                c = rest_ctx.get(a, 0)
                f2, f1 = (rest2[a, b] / c if c else 0.0), rest[b] / n_rest
                k = (int(language_model.bucket(np.array([c]))[0]), *(int(language_model._level(np.array([x]))[0]) for x in (f2, f1)))
                table[k] = [table[k][0] + 1, table[k][1] + f2, table[k][2] + f1]
    lam = language_model.weights([(k[0], x[0], x[1] / x[0], x[2] / x[0]) for k, x in sorted(table.items())], 1 / (v_rest + 1))
    want = {}
    for i, t in rows:
        ws = lm_tokens(t)
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = 0.0
        for a, b in zip(["<begin>", *ws], ws, strict=False):
            c = ctx.get(a, 0)
            w = lam[int(language_model.bucket(np.array([c]))[0])]
            score += math.log10(w[2] * (two[a, b] / c if c else 0) + w[1] * one[b] / n + w[0] / (v + 1))
        want[i, t] = (fold(i) == 1, len(ws), sum(one[w] > 0 for w in ws), n, base, score)
    got = language_model.scores(docs, batch_bytes=20_000).collect()
    by_id = defaultdict(list)
    for (i, _), x in want.items():
        by_id[i].append(x)
    assert len(got) == len(rows)
    for r in got:
        x = (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert any(x[:4] == y[:4] and math.isclose(x[4], y[4], rel_tol=1e-9) and math.isclose(x[5], y[5], rel_tol=1e-6) for y in by_id[r["doc_id"]]), x
    test = [r for r in got if r["held_out"] and r["n_tokens"] > 30]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert language_model.scores(empty).count() == 0


def test_model_is_a_distribution():
    lam = language_model.weights([(0, 10, 0.0, 0.01), (3, 50, 0.2, 0.01), (3, 20, 0.0, 0.02)], 0.001)
    assert np.allclose(lam.sum(1), 1) and (lam[:, 0] > 0).all() and lam[0, 2] == 0


def repeats_loop(rows):
    first = {}
    last = 2**63 - 1
    data = [(last if i is None else i, i, t.encode()) for i, t in rows]
    for k, _, b in data:
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            first[w] = min(first.get(w, last), k)
    out = []
    for k, i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < k:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch_bytes", [5_000, 1 << 21])
def test_suffix_dedup(odd, small, empty, batch_bytes):
    docs = odd.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    got = suffix_dedup.remove_repeats(docs, batch_bytes)
    want = repeats_loop(texts_of(docs))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_hot_lead(spark, monkeypatch):
    """A passage of many documents with other text around it: the windows across its borders are dealt to many parts."""
    rng, asked, ask = np.random.default_rng(8), [], packed.ask
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage, ends = word(120), [word(40) for _ in range(300)]
    rows = [(int(i), word(60) + passage + (ends[i % 300] if i % 2 else word(40))) for i in rng.permutation(3 * suffix_dedup.HOT_RUNS)]

    def counted(*args):
        asked.append(ask(*args))
        return asked[-1]

    monkeypatch.setattr(packed, "ask", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.remove_repeats(df, 20_000)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_loop(rows)
    n = packed.parts(spark)
    assert {r["part"] for r in asked[1].select("part").distinct().collect()} >= set(range(n, 2 * n))


def test_suffix_dedup_short_alphabet(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        parts = [bytes(rng.choice([97, 98], 40)).decode(), "a" * int(rng.integers(0, 130)), "ab" * int(rng.integers(0, 60)), rows[int(rng.integers(len(rows)))][1][:int(rng.integers(0, 200))] if rows else ""]
        rng.shuffle(parts)
        rows.append((int(rng.integers(0, 90)), "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(suffix_dedup.remove_repeats(df, 1500), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_loop(rows)


def shingles_loop(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_loop(rows):
    sets = {i: shingles_loop(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows if i is not None), key=repr)


def test_near_duplicates(odd, small, empty):
    for docs in (odd, small):
        got = near_duplicates.near_duplicates(docs)
        assert rows_of(got.where("doc_id IS NOT NULL"), "doc_id", "n_shingles", "component_id", "kept") == near_loop(texts_of(docs))
        assert got.count() == docs.count()
        kept = near_duplicates.one_of_each(docs)
        assert kept.columns == docs.columns
        assert rows_of(kept.where("doc_id IS NOT NULL"), "doc_id") == sorted({(i,) for i, _, _, k in near_loop(texts_of(docs)) if k}, key=repr)
    assert near_duplicates.near_duplicates(empty).count() == 0 and near_duplicates.one_of_each(empty).count() == 0


def test_texts_under_one_id(spark, monkeypatch):
    """Two texts under id 5: the near copy of 1 follows it, the other stays, whatever the order of rows; and the way of rare classes."""
    words = [f"w{i}" for i in range(60)]
    near, far, other = " ".join([*words[:-1], "end"]), " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(1, " ".join(words)), (5, near), (5, far), (9, far + " tail"), (5, other), (5, near), (7, other), (None, far), (8, ""), (8, "")]
    want = sorted([(1, 1, True), (5, 1, False), (5, 1, False), (5, 5, True), (9, 5, False), (5, 5, True), (7, 5, False), (None, 5, False), (8, 8, True), (8, 8, True)], key=repr)
    for hot, order in ((near_duplicates.HOT, rows), (1, rows[::-1]), (1, rows[3:] + rows[:3]), (near_duplicates.HOT, rows[5:] + rows[:5])):
        monkeypatch.setattr(near_duplicates, "HOT", hot)
        df = spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)
        assert rows_of(near_duplicates.near_duplicates(df), "doc_id", "component_id", "kept") == want
        kept = sorted(near_duplicates.one_of_each(df).collect(), key=repr)
        assert sorted(map(tuple, kept), key=repr) == sorted([(1, " ".join(words)), (5, far), (5, other), (None, far), (8, "")], key=repr)


def test_rare_classes(small, monkeypatch):
    """With no class common, every row finds its component by digest."""
    monkeypatch.setattr(near_duplicates, "HOT", 1)
    assert rows_of(near_duplicates.near_duplicates(small), "doc_id", "n_shingles", "component_id", "kept") == near_loop(texts_of(small))


def test_near_duplicates_of_edited_copies(spark, monkeypatch):
    """Chains of edits around the threshold, in groups larger than a block."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rng = np.random.default_rng(9)
    rows = []
    for f in range(6):
        words = [f"f{f}w{k}" for k in range(int(rng.integers(6, 120)))]
        for _ in range(40):
            ws = list(words)
            for _ in range(int(rng.integers(0, 1 + len(ws) // 12))):
                ws[int(rng.integers(len(ws)))] = f"e{int(rng.integers(10**6))}"
            rows.append((len(rows) * 3 % 241, " ".join(ws)))
            if rng.random() < 0.3:
                words = ws
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(near_duplicates.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == near_loop(rows)


def test_pigeonhole():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 65536, 30).astype(np.uint16)
        b = a.copy()
        b[rng.choice(30, 17, replace=False)] ^= 1
        k = near_duplicates.keys_of(np.stack([a, b]))
        assert (k[0] == k[1]).any()


def test_stated_loss():
    nd, p = near_duplicates, near_duplicates.PERCENT / 100
    at_most = lambda n, k, p: sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
    no_key = at_most(nd.WIDTH, nd.WIDTH - nd.ERRORS - 1, p)**nd.CHUNKS
    far = 1 - at_most(nd.CHUNKS * nd.WIDTH, nd.CHUNKS * (nd.ERRORS + 1) - 1, 1 - p)
    assert (f"{no_key:.1e}", f"{far:.0e}") == ("1.2e-06", "5e-05")
    assert "no key at all with 1.2e-6" in nd.__doc__ and "probability 5e-5" in nd.__doc__


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (200, 2))] + [(500, x) for x in range(501, 560)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    comp = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: c for x, c in comp.items() if x in linked}


def mix_targets_loop(sizes):
    """sizes by source in order; the excess is given away again and again."""
    w = {s: 1 + k % 3 for k, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in sizes if x not in capped) for s in sizes}
        over = {s for s in sizes if t[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("block_words", [7, 1024])
def test_mixing(spark, odd, small, empty, block_words):
    for docs in (odd, small.select("doc_id", "text", "source")):
        out = mixing.mix(docs, carry=("source",), block_words=block_words).collect()
        rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
        order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
        sizes = {s: sum(n for _, x, n in rows if x == s) for s in order}
        want = mix_targets_loop(sizes)
        assert sorted(((r["doc_id"], r["source"], r["size"]) for r in out), key=repr) == sorted(rows, key=repr)
        for s in order:
            own = [r for r in out if r["source"] == s]
            assert all(math.isclose(r["target"], want[s], rel_tol=1e-9) and r["source_size"] == sizes[s] for r in own)
            assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
        again = mixing.mix(docs, carry=("source",), block_words=block_words)
        assert rows_of(again, "doc_id", "source", "size", "taken") == sorted(((r["doc_id"], r["source"], r["size"], r["taken"]) for r in out), key=repr)
    assert mixing.mix(empty).count() == 0


def uses_of(docs, block_words):
    return [tuple(r) for r in mixing.sequence(docs, block_words).select("slot", "source", "doc_id", "from_word", "words").collect()]


def shares_off(uses):
    """The largest gap, in words, between a prefix of the sequence and the sources' shares of the whole."""
    uses, total = sorted(uses, key=lambda u: u[0]), Counter()
    for _, s, _, _, n in uses:
        total[s] += n
    everything, seen, done, worst = sum(total.values()), Counter(), 0, 0.0
    for at, (slot, s, _, _, n) in enumerate(uses):
        seen[s] += n
        done += n
        if at + 1 == len(uses) or uses[at + 1][0] != slot:
            worst = max(worst, *(abs(seen[k] - total[k] * done / everything) for k in total))
    return worst


def test_schedule_decides(small, monkeypatch):
    """Any prefix of the sequence holds the sources by their shares, up to a few blocks; other points give another order, worse shares, and the same totals."""
    docs = small.select("doc_id", "text", "source")
    uses, first = uses_of(docs, 64), {r["doc_id"]: r["first_slot"] for r in mixing.mix(docs, block_words=64).collect()}
    assert shares_off(uses) < 8 * 64
    monkeypatch.setattr(mixing, "van_der_corput", lambda i: i * 0)
    other, then = uses_of(docs, 64), {r["doc_id"]: r["first_slot"] for r in mixing.mix(docs, block_words=64).collect()}
    assert shares_off(other) > 8 * 64 and first != then
    assert sorted(u[2:] for u in uses) == sorted(u[2:] for u in other)


@pytest.mark.parametrize("block_words", [16, 1024])
def test_sequence_makes_up_the_mix(odd, small, block_words):
    """Words, uses and first slots of every document are those of its rows in the sequence; no row reaches beyond its document."""
    for docs in (odd, small):
        by = defaultdict(list)
        for slot, s, i, at, n in uses_of(docs, block_words):
            by[i, s].append((slot, at, n))
        want = defaultdict(lambda: [0, 0, 0, []])
        for r in mixing.mix(docs, carry=("source",), block_words=block_words).collect():
            w = want[r["doc_id"], r["source"]]
            w[0], w[1], w[2] = w[0] + r["taken"], w[1] + r["uses"], max(w[2], r["size"])
            w[3] += [r["first_slot"]] if r["uses"] else []
        assert set(by) == {k for k, w in want.items() if w[1]}
        for k, pieces in by.items():
            taken, uses, size, firsts = want[k]
            assert sum(n for *_, n in pieces) == taken and len(pieces) == uses and min(p[0] for p in pieces) == min(firsts)
            assert all(0 <= at and at + n <= size for _, at, n in pieces)


def test_warc(spark, tmp_path):
    rows = [(3, "u3", "a" * 100), (1, "u1", "a" * 100), (2, None, "b" * 99), (4, "u\r\nWARC-Type: x", "b" * 99), (5, "u5", None), (5, "u5", None), (6, "u ", "é" * 60), (7, "", "é" * 60), (1, "again", "a" * 100),
            (None, "n", "a" * 100), (None, "n2", "c" * 200), (None, "n3", "c" * 200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    folder = f"file://{tmp_path}/archive"
    got = rows_of(warc.archive(pages, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        low = min((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None)
        again = len(b) >= 100 and low is not None and i != low
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low if again else None))
    assert got == sorted(want, key=repr)
    store = spark.read.parquet(f"{folder}/payloads")
    assert store.count() == len({h or "" for _, _, h in rows})
    for r in warc.reconstruct(spark, folder).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert body.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(body) - 4
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body[:-4]).hexdigest()
    assert warc.reconstruct(spark, folder).count() == len(rows)
    store.withColumn("payload", store["payload"].substr(2, 10**6)).write.parquet(f"{folder}2/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}2/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{folder}2").collect()
    assert warc.archive(pages.limit(0), f"file://{tmp_path}/empty").count() == 0
