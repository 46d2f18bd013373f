"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is one batch of documents inside a task: their words become numbers of the benchmark's vocabulary (0 for
any other word and between documents), and the suffixes that can begin with a test window are sorted by their
leading words into a suffix array. Every test suffix is looked up in it by binary search; the range found is all its
occurrences. Occurrences on one diagonal of document and item join to the longest verbatim matches. What a task holds grows with its shard,
not with the product of occurrences in documents and in items.

Documents are never shuffled. The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES``, whose size is
checked first: usually there is one block, and more of them are applied one after the other and merged by row.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a window is ``WINDOW`` consecutive words of an
item, or the whole item if it has fewer.

Defined cases: null and empty texts have no words and no windows; items with a null id mark words but are not
listed; repeated items count once; repeated documents give repeated rows; empty tables give no rows or no hits;
further columns are ignored by ``matches`` and kept by ``remove_affected``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.staging import stage
from candlewick.llm.common import narrow_batches, texts

WINDOW = 10
BLOCK_BYTES = 16 << 20
# pairs of equal windows that are held at a time while maximal matches are sought
PAIRS = 1 << 20
_PAIR_BITS = 24
# lower case, and every ASCII byte that is no letter or digit becomes a space
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _pairs(ids: np.ndarray) -> np.ndarray:
    a, b = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
    return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


class TestIndex:
    """The test windows of a block of items, grouped by length, each with the items that have it and the places where it stands."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items = [None if i is None else str(i) for i, _ in items]
        self.names = sorted({i for i in self.items if i is not None})
        number = {i: n for n, i in enumerate(self.names)}
        self.pair = np.zeros(1 << _PAIR_BITS, bool)
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            ws = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text or "")], ">u4")
            m = min(window, len(ws))
            if m > 1:
                self.pair[_pairs(ws)] = True
            if m:
                by_length.setdefault(m, []).append((k, ws))
        self.groups = [_Windows(m, found, [number.get(i, -1) for i in self.items]) for m, found in by_length.items()]

    def search(self, ids: np.ndarray) -> list[tuple[_Windows, np.ndarray]]:
        """For each length that occurs in a shard of word numbers: the windows, and which of them starts at each position (-1: none)."""
        out = []
        padded = np.concatenate([ids, np.zeros(max((g.words for g in self.groups), default=0), ids.dtype)])
        follows = self.pair[_pairs(padded)] & (padded[:-1] > 0) & (padded[1:] > 0) if len(padded) > 1 else np.zeros(0, bool)
        for g in self.groups:
            can = ids > 0
            for j in range(g.words - 1):  # a window's pairs of neighbours all stand in the benchmark
                can &= follows[j:j + len(ids)]
            at = np.flatnonzero(can)
            if not len(at):
                continue
            lead = np.ascontiguousarray(padded[at[:, None] + np.arange(g.words)]).astype(">u4").view(f"S{4 * g.words}").ravel()
            order = np.argsort(lead, kind="stable")  # the shard's suffix array
            lead, at = lead[order], at[order]
            stands = np.full(len(ids), -1, np.int64)
            if len(lead) < len(g.keys):  # both sides are sorted: the shorter one is looked up in the longer one
                w = np.minimum(np.searchsorted(g.keys, lead), len(g.keys) - 1)
                same = g.keys[w] == lead
                stands[at[same]] = w[same]
            else:
                low, high = np.searchsorted(lead, g.keys, "left"), np.searchsorted(lead, g.keys, "right")
                stands[at[_ranges(low, high)]] = np.repeat(np.arange(len(low)), high - low)
            if (stands >= 0).any():
                out.append((g, stands))
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers low[i] .. high[i] - 1, one range after the other."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


class _Windows:
    """All windows of one length: sorted keys, the windows of the items in a row (-1 between items), and for each key where it stands there."""

    def __init__(self, words: int, found: list[tuple[int, np.ndarray]], names: list[int]):
        self.words = words
        rows = [np.lib.stride_tricks.sliding_window_view(ws, words) for _, ws in found]
        keys, which = np.unique(np.ascontiguousarray(np.concatenate(rows)).astype(">u4").view(f"S{4 * words}").ravel(), return_inverse=True)
        self.keys = keys
        starts = np.cumsum([1, *(len(r) + 1 for r in rows)])  # of the items in the row
        place = np.concatenate([np.arange(len(r)) + s for r, s in zip(rows, starts, strict=False)])
        self.row = np.full(int(starts[-1]) + 1, -1, np.int64)
        self.row[place] = which
        self.starts, self.item = starts, np.array([k for k, _ in found], np.int64)
        order = np.argsort(which, kind="stable")
        self.place, self.bounds = place[order], np.searchsorted(which[order], np.arange(len(keys) + 1))
        # items by window, each once
        name = np.repeat(np.array(names, np.int64)[self.item], [len(r) for r in rows])
        pair = np.unique(np.stack([which, name])[:, name >= 0], axis=1)
        self.names, self.name_bounds = pair[1], np.searchsorted(pair[0], np.arange(len(keys) + 1))


def longest(g: _Windows, stands: np.ndarray, at_once: int = PAIRS) -> list[tuple[int, int, int, int]]:
    """Maximal verbatim matches (position, item number, item word, words): windows in a row on one diagonal are one.

    A pair of equal windows begins a match unless the windows before them are equal too, and ends one likewise. Pairs are
    made ``at_once`` at a time and only beginnings and ends stay.
    """
    around = np.concatenate([[-1], stands, [-1]])
    here = np.flatnonzero(stands >= 0)
    count = g.bounds[stands[here] + 1] - g.bounds[stands[here]]
    cut = np.unique(np.searchsorted(np.cumsum(count), np.arange(at_once, count.sum() + at_once, at_once), "left") + 1)
    first, last = [], []
    for some, n in zip(np.split(here, cut[cut < len(here)]), np.split(count, cut[cut < len(here)]), strict=True):
        w = stands[some]
        pos, place = np.repeat(some, n), g.place[_ranges(g.bounds[w], g.bounds[w + 1])]
        for ends, step in ((first, -1), (last, 1)):
            beyond = around[pos + 1 + step]
            edge = (beyond < 0) | (beyond != g.row[place + step])
            ends.append(np.stack([pos[edge], place[edge]]))
    (p, f), (q, _) = (e[:, np.lexsort((e[0], e[0] - e[1]))] for e in (np.concatenate(x, axis=1) for x in (first, last)))
    k = np.searchsorted(g.starts, f, "right") - 1
    return list(zip(p.tolist(), g.item[k].tolist(), (f - g.starts[k]).tolist(), (q - p + g.words).tolist(), strict=True))


def scan_batch(index: TestIndex, batch: list[str | None], locate: bool = True) -> list[tuple[int, list[tuple[int, int]], list[str], list[tuple]]]:
    """For each text: number of words, spans of hit words, item ids found and, with ``locate``, maximal matches (item id, word, item word, words)."""
    docs = [words_of(t or "") for t in batch]
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum([0, *(sizes + 1)])
    get = index.ids.get
    ids = np.zeros(int(starts[-1]), np.int64)
    for s, d in zip(starts, docs, strict=False):
        if d:
            ids[s:s + len(d)] = [get(w, 0) for w in d]
    out = [(int(n), [], [], []) for n in sizes]
    edge, met = np.zeros(len(ids) + 1, np.int64), [[] for _ in docs]
    doc_of = lambda pos: np.searchsorted(starts, pos, "right") - 1
    for n, (g, stands) in enumerate(index.search(ids)):
        at = np.flatnonzero(stands >= 0)
        edge[at] += 1
        np.subtract.at(edge, at + g.words, 1)
        for d, w in np.unique(np.stack([doc_of(at), stands[at]]), axis=1).T.tolist():
            met[d].append((n, w, g))
        if locate:
            for p, k, o, words in longest(g, stands):
                d = int(doc_of(p))
                out[d][3].append((index.items[k], p - int(starts[d]), o, words))
    hit = np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)
    turn = np.flatnonzero(np.diff(hit))
    for s, e, d in zip(turn[::2].tolist(), turn[1::2].tolist(), doc_of(turn[::2]).tolist(), strict=True):
        out[d][1].append((s - int(starts[d]), e - int(starts[d])))
    known: dict[tuple, list[str]] = {}  # documents with the same windows have the same items
    for row, windows in zip(out, met, strict=True):
        if windows:
            key = tuple((n, w) for n, w, _ in windows)
            if key not in known:
                has = np.zeros(len(index.names), bool)
                for _, w, g in windows:
                    has[g.names[g.name_bounds[w]:g.name_bounds[w + 1]]] = True
                known[key] = [index.names[i] for i in np.flatnonzero(has)]
            row[2].extend(known[key])
    return out


def _blocks(items: DataFrame, block_bytes: int) -> int:
    return max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))


def index_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of about ``block_bytes`` at most, one at a time."""
    items = benchmark.select("item_id", "text")
    n = _blocks(items, block_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield TestIndex([tuple(r) for r in (items if n == 1 else items.where(part == b)).distinct().collect()])


_FOUND = "n_words bigint, hits array<struct<first: bigint, behind: bigint>>, items array<string>"
_MATCHES = ", matches array<struct<item_id: string, word: bigint, item_word: bigint, words: bigint>>"


def _scan(docs: DataFrame, index: TestIndex, keep: list[str], locate: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_BYTES of text
    found = StructType.fromDDL(_FOUND + (_MATCHES if locate else ""))
    schema = StructType([*docs.select(*keep).schema.fields, *found.fields])
    kinds = to_arrow_schema(found)

    def run(batches):
        for b in batches:
            rows = scan_batch(sent.value, b.column("text").to_pylist(), locate)
            cols = [pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"first": s, "behind": e} for s, e in r[1]] for r in rows], kinds.field("hits").type),
                    pa.array([r[2] for r in rows], kinds.field("items").type)]
            if locate:
                cols.append(pa.array([[dict(zip(("item_id", "word", "item_word", "words"), m, strict=True)) for m in r[3]] for r in rows], kinds.field("matches").type))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *found.names])

    narrow_batches(docs.sparkSession)
    return docs.select(*keep, "text").mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, locate: bool = True) -> DataFrame:
    """doc_id, n_words, hits (spans of hit words), items (ids as sorted strings) and, with ``locate``, the maximal verbatim matches of every row.

    Matches are as many as there are shared passages of documents and items; who needs spans and items only leaves them out.
    """
    if _blocks(benchmark, block_bytes) == 1:
        return _scan(texts(docs), next(index_blocks(benchmark, block_bytes)), ["doc_id"], locate)
    rows = stage(texts(docs).withColumn("_row", F.monotonically_increasing_id()))
    every = None
    for index in index_blocks(benchmark, block_bytes):  # one on the driver at a time
        part = stage(_scan(rows, index, ["_row", "doc_id"], locate))
        every = part if every is None else every.unionByName(part)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    met = every.groupBy("_row", "doc_id", "n_words").agg(*[flat(c).alias(c) for c in every.columns[3:]])
    join = F.expr("""aggregate(hits, array(), (a, h) -> CASE WHEN size(a) > 0 AND h.first <= element_at(a, -1).behind
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'behind', greatest(h.behind, element_at(a, -1).behind))))
        ELSE concat(a, array(h)) END)""".replace("array(), (a", "CAST(array() AS array<struct<first: bigint, behind: bigint>>), (a"))
    return met.withColumn("hits", join).drop("_row")


def remove_affected(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no test window occurs, with all their columns."""
    narrow_batches(docs.sparkSession)
    for index in index_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                keep = [not r[1] for r in scan_batch(sent.value, b.column("text").to_pylist(), locate=False)]
                yield b.filter(pa.array(keep, type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
