"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds and what confirms them:

* email, ip (four parts of at most 255), card (13 to 19 digits, Luhn), phone (+, 9 to 15 digits): the base
  kinds. A confirmed base span is always kept; words around it only move its score.
* iban (mod 97), ssn (three groups, valid areas) and local_phone: added kinds. They never overlap an
  accepted span. iban needs its checksum only; the two without a checksum need a word of their
  context within ``CONTEXT_CHARS``, which lifts their score over ``ACCEPT``.

Every matcher takes a whole run of its characters at once, so a text costs time in proportion to its
length, also if it is one endless run of digits or name characters. Offsets are code points, end exclusive.

Defined cases: null text is empty (no spans, the digest of the empty string); repeated rows give repeated
rows; an empty table gives an empty result; further columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from candlewick.llm.common import doc_id_type, narrow_batches, per_row, sha256_hex

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
ACCEPT = 0.5
CONTEXT_CHARS = 40

_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIGIT = re.compile("[0-9]")

#: Score before context, words that raise it and words that lower it (lower case, whole words).
SCORES: dict[str, tuple[float, frozenset[str], frozenset[str]]] = {
    "email": (0.9, frozenset({"email", "mail", "contact"}), frozenset({"example"})),
    "ip": (0.6, frozenset({"ip", "host", "address", "server"}), frozenset({"version", "release", "section"})),
    "card": (0.8, frozenset({"card", "visa", "credit", "payment"}), frozenset({"order", "isbn", "serial"})),
    "phone": (0.7, frozenset({"phone", "tel", "call", "mobile", "fax"}), frozenset({"version"})),
    "iban": (0.9, frozenset({"iban", "account", "bank"}), frozenset()),
    "ssn": (0.3, frozenset({"ssn", "social", "security"}), frozenset({"part", "serial"})),
    "local_phone": (0.3, frozenset({"phone", "tel", "call", "mobile", "fax"}), frozenset({"order", "serial"})),
}
_WORD = re.compile("[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an IBAN: first four characters to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans that pass mod 97. The pattern may run on into following words, so the ends of its groups are tried, the longest first;
    without success the search goes on at the next group."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        while end > start and not (len(code := text[start:end].replace(" ", "")) >= 15 and mod97(code)):
            end = text.rfind(" ", start, end)  # -1 when no group is left
        if end > start:
            out.append((start, end))
            at = end
        else:
            gap = text.find(" ", start)
            at = gap + 1 if 0 <= gap < m.end() else m.end()
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """For each @, the run of name characters before it is the only possible start."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_NAME))
        m = _HOST.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Confirmed spans of the base kinds, leftmost and non-overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = m.group().split(".")
            if len(parts) == 4 and all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in parts):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out["phone"].append(m.span())
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    base, up, down = SCORES[kind]
    words = set(_WORD.findall(text[max(0, start - CONTEXT_CHARS):start].lower())) | set(_WORD.findall(text[end:end + CONTEXT_CHARS].lower()))
    s = base + 0.3 * bool(words & up) - 0.3 * bool(words & down)
    return round(min(1.0, max(ACCEPT if kind in KINDS else 0.0, s)), 2)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All accepted spans as (kind, start, end, score): base kinds first, by kind and start."""
    base = base_spans(text)
    out = [(k, s, e, score(k, text, s, e)) for k in KINDS for s, e in base[k]]
    if not _DIGIT.search(text):
        return out
    taken = sorted((s, e) for _, s, e, _ in out)
    for kind, pattern in zip(ADDED, (_IBAN, _SSN, _LOCAL), strict=True):
        fresh = []
        for s, e in ibans(text) if kind == "iban" else (m.span() for m in pattern.finditer(text)):
            if (x := score(kind, text, s, e)) >= ACCEPT:
                fresh.append((kind, s, e, x))
        free, i, reach = [], 0, 0
        for f in fresh:  # both lists are in order of start
            while i < len(taken) and taken[i][0] < f[2]:
                reach, i = max(reach, taken[i][1]), i + 1
            if reach <= f[1]:
                free.append(f)
        out += free
        taken = sorted(taken + [(s, e) for _, s, e, _ in free])
    return out


def joined(found: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans as text, and their scores in the same order."""

    def make():
        def row(doc_id, text):
            found = spans(text)
            base = [f for f in found if f[0] in KINDS]
            n = [sum(f[0] == k for f in base) for k in KINDS]
            return doc_id, *n, sha256_hex(joined(base).encode()), joined(found), [f[3] for f in found]

        return row

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return per_row(docs, f"doc_id {doc_id_type(docs)}, {counts}, base_sha256 string, spans string, scores array<double>", make)


def masked(text: str) -> str:
    """``text`` with every accepted span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans(text), key=lambda f: (f[1], -f[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with masked texts; ``n_chars``, where there is one, counts the new text."""
    narrow_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for b in batches:
            old = b.column("text").to_pylist()
            new = [None if t is None else masked(t) for t in old]
            cols = dict(zip(names, b.columns, strict=True)) | {"text": pa.array(new, type=b.column("text").type)}
            if "n_chars" in cols:
                kind = cols["n_chars"].type
                cols["n_chars"] = pa.array([n if t == u else len(u) for n, t, u in zip(cols["n_chars"].to_pylist(), old, new, strict=True)], type=kind)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
