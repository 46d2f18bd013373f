"""Operators on single texts against plain loops over the same rows."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import pytest
from tests.llm.conftest import rows_of

from candlewick.llm import chat, decontaminate, pii, quality, token_counts
from candlewick.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def both(odd, small):
    return [(r["doc_id"], r["text"]) for d in (odd, small) for r in d.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    from check_oracle import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    verdict, n = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert verdict == "ok" and n > 0


def test_token_counts(odd, small, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd, small):
        want = []
        for r in docs.select("doc_id", "text").collect():
            n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
            want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 1024))
        assert rows_of(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(empty).count() == 0


def quality_loop(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_ledger(odd, small, empty):
    for docs in (odd, small):
        want = [(r["doc_id"], *quality_loop(r["text"] or "")) for r in docs.collect()]
        book = quality.ledger(docs)
        assert rows_of(book, "doc_id", *quality.MEASURES[:5]) == sorted(want, key=repr)
        keep = rows_of(book.where(~quality.rejected_by("v2")), "doc_id")
        assert rows_of(quality.accepted(docs), "doc_id") == keep
        assert quality.accepted(docs).columns == docs.columns
    assert quality.ledger(empty).count() == 0 and quality.accepted(empty).count() == 0


def test_quality_verdicts(odd):
    """Every policy from one stored ledger; the count of a sole rule is that of the whole table."""
    book = odd.select("doc_id", "text").transform(quality.ledger).cache()
    rows = quality.verdicts(book).collect()
    sole = Counter(r["fail_bits"] for r in rows)
    assert len(rows) == book.count()
    for r in rows:
        failed = [n for i, n in enumerate(quality.RULES) if r["fail_bits"] >> i & 1]
        assert r["kept_v2"] == (not failed) and r["kept_v1"] == (not {"short", "repeats", "symbols"} & set(failed))
        assert (r["only_rule"], r["only_rule_docs"]) == ((failed[0], sole[r["fail_bits"]]) if len(failed) == 1 else (None, None))
    assert quality.verdicts(book.limit(0)).count() == 0


def test_quality_ablations(small):
    book = quality.ledger(small).collect()
    for r in quality.ablations(quality.ledger(small)).collect():
        bit = quality.mask(r["rule"])
        assert r["failed"] == sum(bool(b["fail_bits"] & bit) for b in book)
        assert r["only"] == sum(b["fail_bits"] == bit for b in book)
        assert r["kept_without"] == sum(b["fail_bits"] & ~bit == 0 for b in book)


def test_quality_agrees_with_labels(spark):
    """Held-out labels: the policy rejects most of the low quality and keeps the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in quality.accepted(docs).select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good, bad = ([r["doc_id"] in kept for r in labels if r["quality"] == q] for q in (1, 0))
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.1 * len(bad)


def luhn_ok(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def pii_loop(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")),
                  "card": 13 <= len(digits) <= 19 and luhn_ok(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(odd, small, empty):
    cases = both(odd, small)
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for d in (odd, small) for r in pii.find(d).collect())
    want = Counter()
    for i, t in cases:
        f = pii_loop(t or "")
        n = Counter(k for k, _, _ in f)
        want[i, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{s}:{e}" for k, s, e in f))] += 1
    assert got == want and sum(x[1] for x in got) and sum(x[3] for x in got)
    assert pii.find(empty).count() == 0


def test_personal_data_edges():
    for t in ("a@b.c_d@e.f", "a@b@c.d", "x.@y.z", "@a.b", "a@b..c", "a@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "001.02.3.255", "4111-1111-1111-1111 5", "+1 23456 789)", "++12345678901",
              "a.b+c%d@e-f.g.h@i.j"):
        want = pii_loop(t)
        got = [(k, s, e) for k, v in pii.base_spans(t).items() for s, e in v]
        assert got == want, t
    kinds = {k: (s, e) for k, s, e, _ in pii.spans("DE89 3704 0044 0532 0130 00 my iban; ssn 123-45-6789; call (303) 555-0199; and far from it the part 123-45-6780")}
    assert set(kinds) >= {"iban", "ssn", "local_phone"}
    assert not pii.spans("serial 123-45-6789 and DE88 3704 0044 0532 0130 00")


def test_redaction_keeps_columns_and_clean_rows(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    new = {r["doc_id"]: r for r in out.collect()}
    old = {r["doc_id"]: r for r in odd.collect()}
    assert new[5] == old[5] and new[0]["text"] is None
    assert new[15]["text"].startswith("mail [EMAIL], c@[EMAIL] [IP].5, [CARD] [PHONE]") and new[15]["n_chars"] == len(new[15]["text"])
    assert all(not pii_loop(r["text"] or "") for r in new.values())


def test_chat_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "\\", "a\\nb", "[\\INST]", "<s>x</s>", "\\\\[/INST]\\", "x\n[INST]user\ny[/INST]", "[/INST", "", None, "é \r\n", "y" * 300_000, "</s>" * 5000]
    roles = ["user", "assistant", "system", None, "odd\nrole", "back\\nslash", "[/INST]", "a\\\nb"]
    rows = [(c, t, roles[(c + t) % len(roles)], bad[(c * 3 + t) % len(bad)], "clash") for c in range(30) for t in range(1 + c % 6)]
    rows += [(None, 0, "user", "x", ""), (31, None, "user", "no turn", ""), (31, 0, "user", "tie b", ""), (31, 0, "user", "tie a", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    digest = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert len(out) == 32
    for c in out:
        own = sorted(((t is None, t, r or "", x or "") for i, t, r, x, _ in rows if i == c), key=lambda k: (k[0], k[1] or 0, k[2], k[3]))
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [k[2:] for k in own]
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert digest[c]["loss_chars"] == len(loss) and digest[c]["loss_sha256"] == sha(loss)
        assert digest[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)) and digest[c]["formatted_chars"] == len(out[c]["formatted"])
    assert out[0]["escaped"] and any(not r["escaped"] for r in out.values())
    assert chat.format_conversations(df.limit(0)).count() == 0
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan


def contaminated_loop(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    hit, found = set(), set()
    for i, ws in items:
        m = min(10, len(ws))
        windows = {tuple(ws[k:k + m]) for k in range(len(ws) - m + 1)} if m else set()
        for k in range(len(w) - m + 1):
            if tuple(w[k:k + m]) in windows:
                hit |= set(range(k, k + m))
                found |= {i} - {None}
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_decontamination(spark, odd, block_bytes):
    from tests.llm.conftest import PASSAGE

    items = [(1, PASSAGE), (1, PASSAGE), (2, "one two"), (3, "TAIL"), (None, "three"), (4, None), (5, "..."), (6, " ".join(PASSAGE.split()[5:17])), (10, "no such words " * 9), (12, PASSAGE + " x")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, n_words string")
    split = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for i, t in items]
    got = [(r["doc_id"], r["n_words"], sum(h["behind"] - h["first"] for h in r["hits"]), list(r["items"])) for r in decontaminate.matches(odd, bench, block_bytes).collect()]
    want = [(r["doc_id"], *contaminated_loop(r["text"] or "", split)) for r in odd.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    long = {r["doc_id"]: max((m["words"] for m in r["matches"]), default=0) for r in decontaminate.matches(odd, bench, block_bytes).collect()}
    assert long[5] == len(PASSAGE.split()) and long[14] == 0
    if block_bytes > 300:
        kept = rows_of(decontaminate.remove_affected(odd, bench), "doc_id")
        assert kept == sorted(((i,) for i, _, n, _ in want if not n), key=repr)
        assert decontaminate.remove_affected(odd, bench.limit(0)).count() == odd.count()


def matches_loop(text, items):
    """Hit words, items and maximal matches of one text, pair by pair."""
    ws, hit, found, matches = decontaminate.words_of(text or ""), set(), set(), set()
    for k, (i, x) in enumerate(items):
        xs = decontaminate.words_of(x or "")
        m = min(10, len(xs))
        same = {(p, o) for p in range(len(ws) - m + 1) for o in range(len(xs) - m + 1) if ws[p:p + m] == xs[o:o + m]} if m else set()
        for p, o in same:
            hit |= set(range(p, p + m))
            if (p - 1, o - 1) not in same:
                n = next(n for n in range(1, len(ws) + 2) if (p + n, o + n) not in same)
                matches.add((None if i is None else str(i), p, o, n - 1 + m, k))
        if same and i is not None:
            found.add(str(i))
    return len(ws), hit, sorted(found), sorted(str(m[:4]) for m in matches)


@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_matches_of_a_shard(pairs, monkeypatch):
    """Few words make many diagonals, repeated windows and items that share them; pairs in many pieces and in one."""
    monkeypatch.setattr(decontaminate.longest, "__defaults__", (pairs,))
    rng = random.Random(pairs)
    for _ in range(60):
        some = rng.choice([1, 2, 3, 30])
        make = lambda n, some=some: " ".join(f"w{rng.randrange(some)}" for _ in range(rng.randint(0, n)))
        items = list({(rng.choice([1, 2, 10, 11, None]), make(rng.choice([3, 14, 25]))) for _ in range(rng.randint(0, 6))})
        docs = [None, "", *(make(40) for _ in range(4)), items[0][1] if items else "x"]
        for text, (n, spans, found, matches) in zip(docs, decontaminate.scan_batch(decontaminate.TestIndex(items), docs), strict=True):
            assert (n, {w for s, e in spans for w in range(s, e)}, found, sorted(map(str, matches))) == matches_loop(text, items)


def test_window_that_all_items_and_documents_share():
    """Thousands of items and a batch of documents with one beginning: work per distinct window, not per pair."""
    start = " ".join(f"s{j}" for j in range(12))
    index = decontaminate.TestIndex([(i, f"{start} " + " ".join(f"q{i}x{j}" for j in range(12))) for i in range(3000)])
    began = time.perf_counter()
    rows = decontaminate.scan_batch(index, [start] * 1000, locate=False)
    assert time.perf_counter() - began < 5 and all(r[1] == [(0, 12)] and len(r[2]) == 3000 for r in rows)


def test_iban_ends():
    """Upper-case words behind an IBAN do not hide it, nor does a second one, nor a false start."""
    one, two = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for t, want in ((f"{one} IS MY IBAN", [one]), (f"{one} BIC COBADEFF", [one]), (f"IBAN {one}, {two}", [one, two]), (f"{two} {one}", [two, one]), (f"{one}X", []), (f"X{one}", []),
                    (f"AB12 {one} END", [one]), ("DE88 3704 0044 0532 0130 00 IS WRONG", []), ("DE89 " * 400, [])):
        assert [t[s:e] for s, e in pii.ibans(t)] == want, t
        assert [t[s:e] for k, s, e, _ in pii.spans(t) if k == "iban"] == want
