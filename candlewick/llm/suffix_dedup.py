"""Removal of repeated 50-byte strings at range-partitioned anchors: grouped by hash, open cases sorted by bytes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Sorting every suffix would
shuffle each text fifty times, so the array is sparse: of the 24-byte strings inside each window of 50 bytes, the one with
the smallest hash (the leftmost of equals) is its anchor. Equal windows have equal anchors at equal offsets, so the
suffixes at anchors, about one in 13, suffice to compare all windows. The windows of one anchor follow each other;
together they are a run of 50 to 76 bytes.

1. Splitters are sampled; anchor suffixes are range-partitioned by their leading 24 bytes. Equal leads never straddle
   a boundary, as a splitter is a whole lead, so neighbouring partitions need no further comparison.
2. Each partition groups by hashes, sorted by lead, run, doc_id; no suffix is sorted here. A run that an earlier document has too
   goes as a whole. Where documents share a lead but differ in their runs, the first document of each distinct
   run is an open case.
3. For open cases, the suffixes of their runs go to the same partitions, are sorted byte by byte over the full window, and
   equal neighbours tell which windows an earlier document has. A lead with more than ``HOT_RUNS`` distinct runs (at the border
   of a passage that many documents share) would go whole into one task; its windows are dealt by a hash of their 50 bytes
   instead, one entry per batch and distinct window with its smallest document.

Leads and runs are compared by 48-bit hashes each in step 2 (a run counts as equal only with both), windows by their
bytes in step 3. Before the shuffle, a batch keeps one entry of each distinct run, so a passage or copy costs one entry per
batch however often it occurs. Texts are staged once (``packed``) and not shuffled again.

Defined cases: null and empty texts have no bytes; texts below 50 bytes keep all; rows with equal doc_id never remove each
other's bytes; a null doc_id is larger than any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import packed
from candlewick.llm.common import doc_id_type
from candlewick.llm.shingles import mixed

LENGTH = 50
LEAD = 24
SPAN = LENGTH - LEAD + 1
BATCH_BYTES = 2 << 20
SAMPLE = 64
SAMPLED_BATCHES = 400
HOT_RUNS = 1024
_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1 << 63)


class Powers:
    """Powers of the hash base and of its inverse, as long as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (np.uint64(_BASE), np.uint64(inverse)))
        return self.up, self.down


class Runs:
    """The anchors of a batch and the runs of windows that belong to them."""

    def __init__(self, ids: list, texts: list[bytes], powers: Powers):
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        self.texts = texts
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        windows = np.zeros(n, bool)
        for s, e in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            windows[s:max(s, e - LENGTH + 1)] = True
        at = np.flatnonzero(windows)
        if not len(at):
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            self.lead = self.run = np.zeros(0, np.uint64)
            return
        up, down = powers.get(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)])
        h = mixed((total[LEAD:] - total[:-LEAD]) * down[:n - LEAD + 1])
        low, reach = h, 1
        while reach < SPAN:  # smallest hash of SPAN neighbours, by doubling
            step = min(reach, SPAN - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        view = np.lib.stride_tricks.sliding_window_view(h, SPAN)
        m = low[at]
        # a window whose smallest hash is new and stands at its end has its anchor there; others keep the one before or look
        doc_first = np.concatenate([[True], at[1:] != at[:-1] + 1])
        new = doc_first | np.concatenate([[True], m[1:] != m[:-1]])
        pick = np.full(len(at), -1, np.int64)
        start = np.flatnonzero(new)
        pick[start] = self._leftmost(view, m, at, start)
        anchor = np.maximum.accumulate(pick)
        stale = np.flatnonzero(anchor < at)  # the same hash again, further on
        if len(stale):
            anchor[stale] = self._leftmost(view, m, at, stale)
        doc = np.searchsorted(self.starts, at, "right") - 1
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        self.first, self.last = at[cut], at[np.append(cut[1:], len(at)) - 1]
        self.anchor, self.doc = anchor[cut], doc[cut]
        self.lead = h[self.anchor] >> np.uint64(16)
        end = self.last + LENGTH
        whole = (total[end] - total[self.first]) * down[self.first]
        self.run = mixed(whole + (end - self.first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(16)

    @staticmethod
    def _leftmost(view, m, at, which):
        out = np.empty(len(which), np.int64)
        for i in range(0, len(which), 100_000):
            w = which[i:i + 100_000]
            out[i:i + 100_000] = at[w] + (view[at[w]] == m[w][:, None]).argmax(1)
        return out

    def parts(self, splitters: np.ndarray) -> np.ndarray:
        """The partition of each anchor, by its leading bytes."""
        if not len(self.anchor):
            return np.zeros(0, np.int64)
        leads = np.lib.stride_tricks.sliding_window_view(self.data, LEAD)[self.anchor]
        return np.searchsorted(splitters, np.ascontiguousarray(leads).view(f"S{LEAD}").ravel(), "right")


class Entries:
    """One entry for each distinct run of a batch and partition: its smallest document."""

    def __init__(self, runs: Runs, splitters: np.ndarray):
        part, ids = runs.parts(splitters), runs.ids[runs.doc]
        self.order = np.lexsort((ids, runs.run, runs.lead, part))
        p, lead, run, self.sorted_ids = part[self.order], runs.lead[self.order], runs.run[self.order], ids[self.order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (lead[1:] != lead[:-1]) | (run[1:] != run[:-1])
        self.group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        self.part, self.lead, self.run, self.id, self.doc = p[head], lead[head], run[head], self.sorted_ids[head], runs.doc[self.order[head]]
        present, at = np.unique(self.part, return_index=True)
        self.spans = {int(q): (int(a), int(b)) for q, a, b in zip(present, at, np.append(at, len(self.part))[1:], strict=True)}

    def states(self, answers: list[dict] | None) -> np.ndarray:
        """By run of the batch: 0 unique, 1 an earlier document has it, 2 open, 3 open at a hot lead."""
        state = np.zeros(len(self.part), np.int64)
        for q, data in packed.by_part(answers).items():
            a, b = self.spans[q]
            state[a:b] = packed.read_ints(data, 1)
        out = np.zeros(len(self.order), np.int64)
        # behind the smallest document of the batch, all others have an earlier one
        out[self.order] = np.where(self.sorted_ids > self.id[self.group], 1, state[self.group]) if len(self.order) else 0
        return out


def _questions(runs: Runs, splitters: np.ndarray):
    e = Entries(runs, splitters)
    for q, (a, b) in e.spans.items():
        docs, ordinal = np.unique(e.id[a:b], return_inverse=True)
        yield q, packed.write_parts(packed.write_ints(np.diff(e.lead[a:b], prepend=np.uint64(0)), 6), packed.write_ints(e.run[a:b], 6),
                                    packed.write_ints(ordinal.astype(np.uint64), 3), docs.astype("<i8").tobytes())


def _compare(asked: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Sort the entries of a partition by lead, run and document, and tell each its state."""
    lead, run, ids, sizes = [], [], [], []
    for _, q in asked:
        s = packed.read_parts(q)
        lead.append(np.cumsum(packed.read_ints(s[0], 6)))
        run.append(packed.read_ints(s[1], 6))
        ids.append(np.frombuffer(s[3], "<i8")[packed.read_ints(s[2], 3).astype(np.int64)])
        sizes.append(len(run[-1]))
    lead, run, ids = np.concatenate(lead), np.concatenate(run), np.concatenate(ids)
    order = np.lexsort((ids, run, lead))
    g, r, d = lead[order], run[order], ids[order]
    new_lead = np.concatenate([[True], g[1:] != g[:-1]])
    new_run = new_lead | np.concatenate([[True], r[1:] != r[:-1]])
    heads, leads = np.flatnonzero(new_run), np.flatnonzero(new_lead)
    head, group = np.cumsum(new_run) - 1, np.cumsum(new_lead) - 1
    distinct = np.add.reduceat(new_run.astype(np.int64), leads)
    across = np.minimum.reduceat(d, leads) < np.maximum.reduceat(d, leads)
    state = np.where(d > d[heads][head], 1, np.where((distinct > 1) & across, np.where(distinct > HOT_RUNS, 3, 2), 0)[group])
    back = np.empty(len(order), np.int64)
    back[order] = state
    cuts = np.cumsum([0, *sizes])
    return [(b, packed.write_ints(back[cuts[i]:cuts[i + 1]], 1)) for i, (b, _) in enumerate(asked)]


def _open_cases(runs: Runs, splitters: np.ndarray, states: np.ndarray):
    """Runs in state 2, by partition, with their bytes."""
    chosen = np.flatnonzero(states == 2)
    if not len(chosen):
        return {}
    part = runs.parts(splitters)[chosen]
    order = np.lexsort((chosen, part))
    chosen, part = chosen[order], part[order]
    present, at = np.unique(part, return_index=True)
    return {int(q): chosen[a:b] for q, a, b in zip(present, at, np.append(at[1:], len(part)), strict=True)}


def _open_question(runs: Runs, chosen: np.ndarray) -> bytes:
    import zstandard

    body = b"".join(runs.data[s:e + LENGTH].tobytes() for s, e in zip(runs.first[chosen].tolist(), runs.last[chosen].tolist(), strict=True))
    return packed.write_parts(packed.write_ints(runs.last[chosen] - runs.first[chosen] + 1, 1), runs.ids[runs.doc[chosen]].astype("<i8").tobytes(),
                              zstandard.ZstdCompressor(level=3).compress(body))


def _compare_windows(asked: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Sort all windows of the open cases of a partition; a bit per window of each case: an earlier document has it."""
    import zstandard

    counts, ids, bodies, sizes = [], [], [], []
    for _, q in asked:
        s = packed.read_parts(q)
        counts.append(packed.read_ints(s[0], 1).astype(np.int64))
        ids.append(np.frombuffer(s[1], "<i8"))
        bodies.append(zstandard.ZstdDecompressor().decompress(s[2]))
        sizes.append(len(ids[-1]))
    counts, ids = np.concatenate(counts), np.concatenate(ids)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts = np.concatenate([[0], np.cumsum(counts + LENGTH - 1)])[:-1]
    case = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(case)) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts[case] + offset]
    suffix = np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()
    order = np.argsort(suffix, kind="stable")
    suffix, d = suffix[order], ids[case][order]
    heads = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))
    earliest = np.repeat(np.minimum.reduceat(d, heads), np.diff(np.append(heads, len(d))))
    hit = np.zeros(len(case), bool)
    hit[order] = d > earliest
    bits = np.zeros(len(counts), np.int64)
    np.add.at(bits, case[hit], 1 << offset[hit])
    cuts = np.cumsum([0, *sizes])
    return [(b, packed.write_ints(bits[cuts[i]:cuts[i + 1]], 4)) for i, (b, _) in enumerate(asked)]


class HotWindows:
    """The distinct windows of a batch's runs in state 3, by a hash of their bytes, behind the ``n`` parts of the leads."""

    def __init__(self, runs: Runs, states: np.ndarray, n: int):
        chosen = np.flatnonzero(states == 3)
        counts = runs.last[chosen] - runs.first[chosen] + 1
        self.at = np.repeat(runs.first[chosen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        self.ids = np.repeat(runs.ids[runs.doc[chosen]], counts)
        self.spans: dict[int, tuple[int, int]] = {}
        if not len(chosen):
            return
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(runs.data, LENGTH)[self.at])
        h = np.zeros(len(rows), np.uint64)
        for i in range(LENGTH):
            h = h * np.uint64(_BASE) + _BYTES[rows[:, i]]
        part = n + (mixed(h) % np.uint64(n)).astype(np.int64)
        windows = rows.view(f"S{LENGTH}").ravel()
        order = np.lexsort((windows, part))
        windows, part = windows[order], part[order]
        heads = np.flatnonzero(np.concatenate([[True], (windows[1:] != windows[:-1]) | (part[1:] != part[:-1])]))
        self.windows, self.least = windows[heads], np.minimum.reduceat(self.ids[order], heads)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        present, at = np.unique(part[heads], return_index=True)
        self.spans = {int(q): (int(a), int(b)) for q, a, b in zip(present, at, np.append(at[1:], len(heads)), strict=True)}

    def questions(self):
        import zstandard

        for q, (a, b) in self.spans.items():
            yield q, packed.write_parts(self.least[a:b].astype("<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(self.windows[a:b].tobytes()))

    def gone(self, answers: dict[int, bytes]) -> np.ndarray:
        """Where windows start that an earlier document has, in this batch or in another."""
        if not self.spans:
            return self.at
        before = np.zeros(len(self.windows), bool)
        for q, (a, b) in self.spans.items():
            before[a:b] = packed.read_ints(answers[q], 1) == 1
        return self.at[before[self.group] | (self.ids > self.least[self.group])]


def _compare_hot(asked: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """For each distinct window of each batch: another batch has it in an earlier document."""
    import zstandard

    sections = [packed.read_parts(q) for _, q in asked]
    ids = [np.frombuffer(s[0], "<i8") for s in sections]
    windows = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(s[1]) for s in sections), f"S{LENGTH}")
    cuts, ids = np.cumsum([0, *map(len, ids)]), np.concatenate(ids)
    order = np.argsort(windows, kind="stable")
    windows, d = windows[order], ids[order]
    heads = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]]))
    hit = np.zeros(len(order), np.int64)
    hit[order] = d > np.repeat(np.minimum.reduceat(d, heads), np.diff(np.append(heads, len(d))))
    return [(b, packed.write_ints(hit[cuts[i]:cuts[i + 1]], 1)) for i, (b, _) in enumerate(asked)]


def _answer_windows(asked: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """A part has either open cases by lead (three sections) or hot windows (two)."""
    return (_compare_hot if len(packed.read_parts(asked[0][1])) == 2 else _compare_windows)(asked)


def _removed(runs: Runs, states: np.ndarray, cases: dict[int, np.ndarray], hot: HotWindows, answers: list[dict] | None) -> np.ndarray:
    """Which bytes of the batch go."""
    change = np.zeros(len(runs.data) + 1, np.int64)
    gone = states == 1
    np.add.at(change, runs.first[gone], 1)
    np.add.at(change, runs.last[gone] + LENGTH, -1)
    answered = packed.by_part(answers)
    at = hot.gone(answered)
    np.add.at(change, at, 1)
    np.add.at(change, at + LENGTH, -1)
    for q in cases:
        bits = packed.read_ints(answered[q], 4)
        for o in range(SPAN):
            at = runs.first[cases[q][(bits >> np.uint64(o)) & np.uint64(1) == 1]] + o
            np.add.at(change, at, 1)
            np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _sample(texts: list[bytes]) -> bytes:
    """Leading bytes at evenly spread places of a batch."""
    data = b"".join(texts)
    if len(data) < LEAD:
        return b""
    at = np.linspace(0, len(data) - LEAD, SAMPLE).astype(np.int64)
    return b"".join(data[i:i + LEAD] for i in at.tolist())


def remove_repeats(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every row."""
    spark = docs.sparkSession
    staged = packed.batches(docs, batch_bytes, _sample)
    # the splitters only balance the partitions: a bounded sample is enough
    marks = b"".join(r["sample"] for r in staged.select("sample").limit(SAMPLED_BATCHES).collect())
    leads = np.sort(np.frombuffer(marks, f"S{LEAD}"))
    n = packed.parts(spark)
    splitters = leads[np.linspace(0, len(leads) - 1, n + 1).astype(np.int64)[1:-1]] if len(leads) else leads
    texts, powers = staged.select("batch", "data"), Powers()

    def ask_runs(row):
        return _questions(Runs(*packed.unpack(row["data"]), powers), splitters)

    first = packed.ask(texts, ask_runs, _compare)

    def ask_windows(row):
        runs = Runs(*packed.unpack(row["data"]), powers)
        states = Entries(runs, splitters).states(row["answers"])
        yield from ((q, _open_question(runs, c)) for q, c in _open_cases(runs, splitters, states).items())
        yield from HotWindows(runs, states, n).questions()

    with_first = packed.joined(texts, first)
    second = packed.ask(with_first, ask_windows, _answer_windows)

    def finish(arriving):
        for arrow in arriving:
            for row in arrow.to_pylist():
                ids, bodies = packed.unpack(row["data"])
                runs = Runs(ids, bodies, powers)
                states = Entries(runs, splitters).states(row["answers"])
                gone = _removed(runs, states, _open_cases(runs, splitters, states), HotWindows(runs, states, n), row["windows"])
                out = []
                for i, s, e, t in zip(ids, runs.starts[:-1].tolist(), runs.starts[1:].tolist(), bodies, strict=True):
                    g = gone[s:e]
                    k = int(g.sum())
                    kept = t if not k else runs.data[s:e][~g].tobytes()
                    spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0
                    out.append((i, e - s, k, spans, kept, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = packed.joined(with_first, second, "windows").mapInArrow(
        finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(doc_id_type(docs)))
