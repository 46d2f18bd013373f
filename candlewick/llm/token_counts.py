"""Token counts of a byte-level BPE vocabulary by heap-and-linked-list merging.

A word starts as its bytes in a doubly linked list. A heap holds the rank of every adjacent pair that
merges; the lowest rank (leftmost among equals) is popped, its two symbols become one, and the two new
neighbour pairs are pushed. Every pop that still fits the list is one merge, so the count of a word is
its bytes minus its merges: no identifier is ever looked up or emitted. A word of n bytes takes
O(n log n), also if it is a megabyte of one letter.

Rows are independent, so there is no shuffle. Each task keeps the counts of short words it has met
in a dictionary of bounded size; what is evicted is only counted again.

Defined cases: null text is empty (0 tokens); the added token's string inside a text is one token, as the
library does by default; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re

import regex
from pyspark.sql import DataFrame

from candlewick.llm.common import doc_id_type, per_row

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CACHE_WORDS = 1_000_000
CACHE_BYTES = 64
# The same splitting for texts of these characters only, in the standard library's faster matcher.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_OTHER_CHARACTER = re.compile(f"[^\t\n\r\\x20-\\x7e{_LETTERS}]")
_FAST_SPLIT = re.compile(f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")


def load(name: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """Merge ranks by pair of byte strings, and the added tokens, of a vocabulary file."""
    import public_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), encoding="utf-8") as f:
        spec = json.load(f)
    # the byte alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): bytes([b]) for b in plain} | {chr(256 + i): bytes([b]) for i, b in enumerate(other)}
    text = lambda s: b"".join(byte[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    return {(text(a), text(b)): i for i, (a, b) in enumerate(pairs)}, [t["content"] for t in spec["added_tokens"]]


def merged_length(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left of ``word`` when no pair merges any more."""
    n = len(word)
    if n < 2:
        return n
    part: list[bytes | None] = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, p) for i in range(n - 1) if (r := ranks.get(p := (part[i], part[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, (a, b) = heapq.heappop(heap)
        j = after[i]
        if part[i] != a or j >= n or part[j] != b:
            continue  # one of the two has merged with another meanwhile
        merges += 1
        part[i], part[j] = a + b, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(p := (part[i], part[k]))) is not None:
                heapq.heappush(heap, (r, i, p))
        h = before[i]
        if h >= 0 and (r := ranks.get(p := (part[h], part[i]))) is not None:
            heapq.heappush(heap, (r, h, p))
    return n - merges


class WordCounts(dict):
    """Token count by word, filled on demand."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        data = word.encode()
        n = merged_length(data, self.ranks)
        if len(data) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def counter(name: str = VOCABULARY):
    """A function from text to token count."""
    import public_tokenizers

    ranks, added = load(name)
    words = regex.compile(public_tokenizers.PATTERN)
    special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
    counts = WordCounts(ranks)

    def count(text: str) -> int:
        pieces = special.split(text) if special else [text]
        split = words.findall if _OTHER_CHARACTER.search(text) else _FAST_SPLIT.findall
        return len(pieces) - 1 + sum(sum(map(counts.__getitem__, split(p))) for p in pieces)

    return count


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def make():
        count = counter(vocabulary)

        def row(doc_id, text):
            n = count(text)
            return doc_id, len(text.encode()), n, n > limit

        return row

    return per_row(docs, f"doc_id {doc_id_type(docs)}, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
