"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements and one integer whose bits
are the failed rules. A policy is a named mask: a document is rejected when a bit of the mask is set. New
versions of a policy, and ablations (what a policy would keep without one of its rules), are bit operations
over the stored ledger; no text is read again.

Words are ``[^\\x20\\x09-\\x0D]+``. Rows are independent: no shuffle, and a text of n words takes O(n).

Defined cases: null and empty texts have no words, fail ``short`` and are rejected; repeated rows give
repeated rows; an empty table gives an empty ledger; further columns are ignored by ``ledger`` and kept by ``accepted``.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from candlewick.llm.common import doc_id_type, narrow_batches, per_row

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_letter_words")

#: Rules by bit: a document fails where the condition over its measurements holds.
RULES: dict[str, str] = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    "stutter": "100 * n_stutter > 20 * n_words",
    "no_letters": "2 * n_letter_words < n_words",
}
BASE = ("short", "repeats")


def mask(*rules: str) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


#: Versioned policies over the same ledger.
POLICIES: dict[str, int] = {
    "v1": mask("short", "repeats", "symbols"),
    "v2": mask(*RULES),
}
CURRENT = "v2"


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    data = text.encode()
    words = data.split()  # splits at exactly \\x20 and \\x09-\\x0D
    n = len(words)
    chars = len(text) - (len(data) - sum(map(len, words)))  # separators are one byte each
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            often = {w for w, c in Counter(windows).items() if c > 1}
            covered = 0
            for i, w in enumerate(windows):
                if w in often:
                    repeated += i + WINDOW - max(i, covered)
                    covered = i + WINDOW
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    letters = sum(1 for w in words if w.isalpha() or w[0] >= 128 or any(64 < (c & 223) < 91 or c >= 128 for c in w))
    return n, chars, sum(text.count(c) for c in SYMBOLS), dup, repeated, lines, stutter, letters


def fail_bits(prefix: str = "") -> Column:
    """The failed rules over the measurement columns, whose names may have a prefix."""
    named = re.compile("|".join(sorted(MEASURES, key=len, reverse=True)))
    conditions = [named.sub(lambda m: prefix + m.group(), c) for c in RULES.values()]
    bits = [F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("bigint")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of every row."""

    def make():
        return lambda doc_id, text: (doc_id, *measure(text))

    cols = ", ".join(f"{m} bigint" for m in MEASURES)
    return per_row(docs, f"doc_id {doc_id_type(docs)}, {cols}", make).withColumn("fail_bits", fail_bits())


def rejected_by(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("bigint")) != 0


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy keeps without it.

    The ledger is first reduced to one row per bit pattern (at most 2 to the number of rules), on the map side.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    whole, rules = POLICIES[policy], [(r, 1 << i) for i, r in enumerate(RULES) if POLICIES[policy] >> i & 1]
    on = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    row = patterns.agg(F.array(*[F.struct(F.lit(r).alias("rule"), total(on(b) != 0).alias("failed"), total(on(whole) == b).alias("only"),
                                          total(on(whole & ~b) == 0).alias("kept_without")) for r, b in rules]).alias("rules"))
    return row.select(F.lit(policy).alias("policy"), F.inline("rules"))


def only_rule(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    """The rule that alone rejects a document under a policy, else NULL."""
    failed = F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("bigint"))
    return F.coalesce(*[F.when(failed == 1 << i, F.lit(r)) for i, r in enumerate(RULES) if POLICIES[policy] >> i & 1])


def verdicts(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A stored ledger with every policy's verdict (``kept_<policy>``), the rule that alone rejects a document under ``policy`` and, from the
    ablations over the same ledger, how many documents only that rule rejects (both NULL for other documents)."""
    alone = ablations(book, policy).select(F.col("rule").alias("only_rule"), F.col("only").alias("only_rule_docs"))
    rows = book.withColumns({**{f"kept_{p}": ~rejected_by(p) for p in POLICIES}, "only_rule": only_rule(policy)})
    return rows.join(F.broadcast(alone), "only_rule", "left")  # one row per rule


def accepted(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows that a policy keeps, with all their columns."""
    narrow_batches(docs.sparkSession)
    own = [f"_rule_{m}" for m in MEASURES]
    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in own]])

    def run(batches):
        for b in batches:
            found = [measure(t or "") for t in b.column("text").to_pylist()]
            cols = [pa.array([f[i] for f in found], type=pa.int64()) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *own])

    return docs.mapInArrow(run, schema).withColumn("_rule_bits", fail_bits("_rule_")).where(~rejected_by(policy, "_rule_bits")).select(*docs.columns)
