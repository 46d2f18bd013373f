"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lowered, then one end. The model is

    P(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1),      b: the bucket of c(v), by powers of two

with counts over all training documents. The weights of each bucket are learned by expectation-maximisation: one fifth
of the documents (remainder 0) is deleted from the counts, and its tokens are explained by the counts of the rest.
These held-out tokens enter as a table over bucket and logarithmic classes of the two estimates, with the mean estimate
of each class, whose size is bounded whatever the corpus.

Counting and lookup go through ``packed``: a batch asks each partition once for all its distinct words and pairs,
with their counts; partitions add up and answer totals. A frequent word costs one entry per batch.

Words and pairs are 64-bit hashes of which a partition holds 48 bits.

Defined cases: null and empty texts are one end; a null doc_id counts as text '' (training); repeated rows count and
are scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import packed
from candlewick.llm.common import doc_id_type
from candlewick.llm.shingles import WordHashes, mixed

FOLDS, TEST, DELETED = 5, 1, 0
BATCH_BYTES = 3 << 20
BUCKETS = 24
ROUNDS = 60
_END, _BEGIN = np.uint64(0x51ED270B), np.uint64(0x2545F491)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def tokens(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word keys, pair keys, first token and number of tokens by document; each document ends with the end token."""
    docs = [t.lower().split() for t in texts]
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    ends = np.cumsum(sizes) - 1
    words = np.empty(int(sizes.sum()), np.uint64)
    at = 0
    for d in docs:
        words[at:at + len(d)] = np.fromiter(map(hashes.__getitem__, d), np.uint64, len(d))
        at += len(d) + 1
    words[ends] = _END
    firsts = np.concatenate([[0], ends[:-1] + 1])
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[firsts] = _BEGIN
    return mixed(words), mixed(mixed(before) * _PAIR + words), firsts, sizes


class Lookup:
    """The distinct keys of a batch in order. A part is a range of keys, so its keys are neighbours here."""

    def __init__(self, keys: np.ndarray, parts: int, inverse: bool = True):
        if inverse:
            self.keys, self.inverse = np.unique(keys, return_inverse=True)
        else:
            self.keys = np.unique(keys)
        width = np.uint64((1 << 64) // parts + 1)
        self.bounds = np.searchsorted(self.keys // width, np.arange(parts + 1, dtype=np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)

    def of(self, p: int) -> slice:
        return slice(self.bounds[p], self.bounds[p + 1])

    def short(self, at: slice) -> np.ndarray:
        """The 48 bits that are sent, as differences."""
        return np.diff(self.keys[at] >> np.uint64(16), prepend=np.uint64(0))


class _Batch:
    """A batch as words and pairs of its tokens; with ``only``, token positions are found for documents of one fold."""

    def __init__(self, row: dict, parts: int, hashes: WordHashes, only: int | None = None):
        self.ids, texts = packed.unpack(row["data"])
        words, pairs, firsts, self.sizes = tokens(texts, hashes)
        self.folds = np.array([fold(i) for i in self.ids], np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.parts = parts
        begin = mixed(np.array([_BEGIN]))  # one more key of the words' table, which is no token
        every = np.concatenate([words, begin])
        self.singles, self.pairs = (Lookup(k, parts, only is None) for k in (every, pairs))
        if only is None:
            self.begin, self.word, self.pair = self.singles.inverse[-1], self.singles.inverse[:-1], self.pairs.inverse
            self.context = np.empty_like(self.word)
            self.context[1:] = self.word[:-1]
            self.context[firsts] = self.begin
        else:
            chosen = np.flatnonzero(self.folds[self.doc] == only)
            before = np.concatenate([begin, words[:-1]])
            before[firsts] = begin
            self.word, self.context, self.pair = self.singles.find(words[chosen]), self.singles.find(before[chosen]), self.pairs.find(pairs[chosen])

    def question(self):
        token_fold = self.folds[self.doc]
        tables = []
        for table, index in ((self.singles, self.word), (self.pairs, self.pair)):
            tables.append((table, *(np.bincount(index[keep], minlength=len(table.keys)) for keep in ((token_fold != TEST) & (token_fold != DELETED), token_fold == DELETED))))
        tables[0][1][self.begin] = ((self.folds != TEST) & (self.folds != DELETED)).sum()
        tables[0][2][self.begin] = (self.folds == DELETED).sum()
        for p in range(self.parts):
            at = [t[0].of(p) for t in tables]
            if any(i.stop > i.start for i in at):
                yield p, packed.write_parts(*(x for (t, c, d), i in zip(tables, at, strict=True) for x in (
                    packed.write_ints(t.short(i), 6), packed.write_ints(c[i], 5), packed.write_ints(d[i], 5))))

    def read(self, answers: list[dict] | None, full: bool) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and of pairs, by key: all training counts, or those without the deleted part."""
        got = packed.by_part(answers)
        out = []
        for k, t in enumerate((self.singles, self.pairs)):
            counts = np.zeros(len(t.keys), np.int64)
            for p, data in got.items():
                i = t.of(p)
                if i.stop > i.start:
                    counts[i] = packed.read_ints(packed.read_parts(data)[2 * k + full], 5)
            out.append(counts)
        return out[0], out[1]


def _answer(parts: int):
    begin = int(mixed(np.array([_BEGIN]))[0])

    def answer(asked: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        sections = [packed.read_parts(q) for _, q in asked]
        replies: list[list[bytes]] = [[] for _ in asked]
        totals = []
        for k in range(2):
            keys = [np.cumsum(packed.read_ints(s[3 * k], 6)) for s in sections]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = []
            for c in (1, 2):
                sums.append(np.bincount(inverse, weights=np.concatenate([packed.read_ints(s[3 * k + c], 5) for s in sections]), minlength=len(distinct)).astype(np.int64))
            rest, full = sums[0], sums[0] + sums[1]
            if k == 0:
                token = distinct != np.uint64(begin >> 16)  # the begin is counted, but is no token
                totals = [rest[token].sum(), full[token].sum(), (rest[token] > 0).sum(), (full[token] > 0).sum()]
            at = 0
            for i, own in enumerate(keys):
                mine = inverse[at:at + len(own)]
                replies[i] += [packed.write_ints(rest[mine], 5), packed.write_ints(full[mine], 5)]
                at += len(own)
        out = [(b, packed.write_parts(*r)) for (b, _), r in zip(asked, replies, strict=True)]
        return [*out, (-1, np.array(totals, "<i8").tobytes())]

    return answer


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0), BUCKETS - 1)


def _share(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(np.asarray(b) > 0, a.shape))


def _level(x: np.ndarray) -> np.ndarray:
    """Logarithmic class of an estimate; 0 for none."""
    return np.where(x > 0, np.clip(np.round(-3 * np.log2(np.where(x > 0, x, 1))), 0, 126).astype(np.int64) + 1, 0)


def weights(table: list[tuple], unseen: float) -> np.ndarray:
    """Weights (uniform, word, pair) by bucket from rows (bucket, tokens, mean pair estimate, mean word estimate)."""
    out = np.tile(np.array([0.01, 0.49, 0.5]), (BUCKETS, 1))
    out[0] = [0.01, 0.99, 0.0]  # an unknown context has no pairs
    rows = np.array(table, float).reshape(-1, 4)
    for b in range(BUCKETS):
        r = rows[rows[:, 0] == b]
        if len(r):
            e = np.stack([np.full(len(r), unseen), r[:, 3], r[:, 2]], 1)
            lam = out[b] if b == 0 else np.full(3, 1 / 3)
            for _ in range(ROUNDS):
                joint = e * lam
                got = (r[:, 1:2] * joint / joint.sum(1, keepdims=True)).sum(0) + np.array([0.5, 0.5, 0.5 * (b > 0)])
                lam = got / got.sum()
            out[b] = lam
    return out


def scores(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    n_parts = packed.parts(spark)
    staged = packed.batches(docs, batch_bytes)
    hashes = WordHashes()

    def question(row, hashes=hashes):
        return _Batch(row, n_parts, hashes).question()

    answers = packed.ask(staged.select("batch", "data"), question, _answer(n_parts))
    totals = np.zeros(4, np.int64)
    for r in answers.where("batch < 0").toLocalIterator():  # four numbers from each partition
        totals += np.frombuffer(r["answer"], "<i8")
    n_rest, n_all, v_rest, v_all = (int(x) for x in totals)
    both = packed.joined(staged.select("batch", "data"), answers)

    def deleted(arriving):
        for arrow in arriving:
            for row in arrow.to_pylist():
                b = _Batch(row, n_parts, hashes, only=DELETED)
                words, pairs = b.read(row["answers"], False)
                context = words[b.context]
                f2 = _share(pairs[b.pair].astype(float), context)
                f1 = words[b.word] / max(n_rest, 1)
                cell = (bucket(context) * 128 + _level(f2)) * 128 + _level(f1)
                cells, inverse = np.unique(cell, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.bincount(inverse, minlength=len(cells)), pa.int64()),
                                                  pa.array(np.bincount(inverse, f2, len(cells)), pa.float64()), pa.array(np.bincount(inverse, f1, len(cells)), pa.float64())],
                                                 names=["cell", "n", "f2", "f1"])

    cells = both.mapInArrow(deleted, "cell bigint, n bigint, f2 double, f1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("f2").alias("f2"), F.sum("f1").alias("f1"))
    # at most BUCKETS * 128 * 128 cells, whatever the corpus
    table = [(r["cell"] >> 14, r["n"], r["f2"] / r["n"], r["f1"] / r["n"]) for r in cells.orderBy("cell").collect()]
    lam = weights(table, 1 / (v_rest + 1)) if n_all else np.tile(np.array([1.0, 0.0, 0.0]), (BUCKETS, 1))

    def scored(arriving):
        for arrow in arriving:
            for row in arrow.to_pylist():
                b = _Batch(row, n_parts, hashes)
                words, pairs = b.read(row["answers"], True)
                c, context = words[b.word], words[b.context]
                f2, f1 = _share(pairs[b.pair].astype(float), context), c / max(n_all, 1)
                w = lam[bucket(context)]
                p = w[:, 2] * f2 + w[:, 1] * f1 + w[:, 0] / (v_all + 1)
                base = np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))
                add = lambda x, b=b: np.bincount(b.doc, x, len(b.ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids, pa.int64()), pa.array(b.folds == TEST), pa.array(b.sizes), pa.array(add((c > 0).astype(float)).astype(np.int64)),
                     pa.array(np.full(len(b.ids), n_all, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = both.mapInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(doc_id_type(docs)))
