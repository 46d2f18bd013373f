"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has 30 components of 16 bits; its distance to another is the number of components that differ. It is
split into 6 chunks of 5. Two signatures at distance 17 or less leave, by pigeonhole, a chunk with at most 2
errors. Each of the 10 ways to choose these 2 errors gives a key of the other 3 components, so a document
has 60 keys, and all such pairs share at least one. (At a similarity of 0.75, a pair lies further apart with
probability 5e-5, and shares no key at all with 1.2e-6; every pair that shares a key is compared exactly.)

1. Texts become sketches: set size, set digest, signature. Equal sets are one class from here on, so exact copies
   cost nothing. The class is known by its smallest doc_id.
2. Keys shared by several classes are groups. Groups of the same members are kept once, under the first key.
3. Texts of the members come in, compressed. A group larger than ``BLOCK`` is cut into blocks, and each pair of blocks
   is a group. Inside a group, pairs not yet connected there, whose first common key is this one and whose sizes
   allow the similarity, are compared on full sets. Only links that connect something are emitted.
4. Connected components of the links, by distributed stars, and back to all documents. Classes that hold a notable share
   of the rows are fewer than ``HOT`` and are sent to the rows; the others are joined by digest.

Sets are sets of 64-bit shingle hashes.

Defined cases: texts without words have an empty set and link with nothing; a null doc_id takes part in no link of
its own, but follows the class of an equal text; rows that repeat a doc_id are judged by their own text: links are between texts,
so one of them may follow a smaller doc_id while another stays (if two classes have the same smallest doc_id, classes are numbered in the
order of doc_id and digest instead); an empty table gives an empty result; further columns are ignored by ``near_duplicates`` and
kept by ``one_of_each``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.staging import stage
from candlewick.llm import shingles
from candlewick.llm.common import narrow_batches, texts
from candlewick.llm.components import components

CHUNKS, WIDTH, ERRORS = 6, 5, 2
PERCENT = 75
BLOCK = 2048
HOT = 1024
_DECODED = 4_000_000
_COMBINATIONS = list(itertools.combinations(range(WIDTH), WIDTH - ERRORS))
KEYS = CHUNKS * len(_COMBINATIONS)
# by the pattern of equal components in a chunk: the first combination they contain
_FIRST = np.array([next((i for i, c in enumerate(_COMBINATIONS) if all(p >> x & 1 for x in c)), 255) for p in range(1 << WIDTH)], np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, digest and signature of every row (the last two null for empty sets)."""
    narrow_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        hashes = shingles.WordHashes()
        for b in batches:
            n, dig, sig = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles.shingle_set(t or "", hashes)
                n.append(len(s))
                dig.append(shingles.digest(s) if len(s) else None)
                sig.append(shingles.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.binary())],
                                             names=["doc_id", "t", "n_shingles", "digest", "signature"])

    return texts(docs).withColumn("t", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, t bigint, n_shingles bigint, digest binary, signature binary")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """KEYS keys of each signature (rows); the low 6 bits of a key are its number."""
    out = np.empty((len(signatures), KEYS), np.uint64)
    wide = signatures.astype(np.uint64)
    for c in range(CHUNKS):
        for i, combination in enumerate(_COMBINATIONS):
            number = np.uint64(c * len(_COMBINATIONS) + i)
            packed = np.full(len(wide), number, np.uint64)
            for x in combination:
                packed = (packed << np.uint64(16)) | wide[:, c * WIDTH + x]
            out[:, int(number)] = (shingles.mixed(packed) & ~np.uint64(63)) | number
    return out


def _keyed(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint16).reshape(-1, shingles.COMPONENTS)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            keys = keys_of(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, KEYS))], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key bigint, id bigint")


def groups(classes: DataFrame) -> DataFrame:
    """key, part and id: the classes that share a key, each set of members once, in parts of bounded size."""
    keyed = _keyed(classes)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("low")).where("n > 1")
    first = shared.groupBy("n", "x", "low").agg(F.min_by("key", F.col("key").bitwiseAND(F.lit(63))).alias("key")).select("key", "n")
    rows = keyed.join(first.hint("merge"), "key")  # grows with the corpus: never broadcast
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    # block b meets the blocks before it (row b) and behind it (column b)
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(o, own) * blocks + F.greatest(o, own))
    small = rows.where(F.col("n") <= BLOCK).select("key", F.lit(0).alias("part"), "id")
    large = rows.where(F.col("n") > BLOCK).select("key", F.explode(pairs).alias("part"), "id")
    return small.unionByName(large)


def compress(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of the text and the text as a compressed binary."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array([z.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())],
                                             names=["doc_id", "t", "packed"])

    return texts(docs).withColumn("t", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, t bigint, packed binary")


class _Sets:
    """Shingle sets of the rows of a group, decoded on demand, with bounded memory."""

    def __init__(self, packed: list[bytes], hashes: shingles.WordHashes):
        import zstandard

        self.packed, self.hashes, self.held, self.sets, self.z = packed, hashes, 0, {}, zstandard.ZstdDecompressor()

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.sets:
            s = shingles.shingle_set(self.z.decompress(self.packed[i]).decode(), self.hashes)
            if self.held + len(s) > _DECODED:
                self.sets, self.held = {}, 0
            self.sets[i] = s
            self.held += len(s)
        return self.sets[i]


def link_group(number: int, ids: np.ndarray, n: np.ndarray, sig: np.ndarray, sets) -> list[tuple[int, int]]:
    """Links that connect the members of one group, as far as they are its own to find."""
    out = []
    comp = np.arange(len(ids))
    weights = 1 << np.arange(WIDTH)
    for p in range(len(ids) - 1):
        rest = np.arange(p + 1, len(ids))
        rest = rest[comp[rest] != comp[p]]
        rest = rest[100 * np.minimum(n[rest], n[p]) >= PERCENT * np.maximum(n[rest], n[p])]
        if not len(rest):
            continue
        patterns = (sig[rest] == sig[p]).reshape(-1, CHUNKS, WIDTH) @ weights
        first = (_FIRST[patterns] + np.arange(CHUNKS) * len(_COMBINATIONS)).min(axis=1, initial=10_000, where=_FIRST[patterns] < 255)
        rest = rest[first == number]
        mine = sets[p] if len(rest) else None
        for at in range(0, len(rest), 256):
            some = rest[at:at + 256]
            others = [sets[i] for i in some.tolist()]
            flat = np.concatenate(others)
            where = np.searchsorted(mine, flat)
            where[where == len(mine)] = 0
            both = np.add.reduceat((mine[where] == flat).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))
            for i in some[100 * both >= PERCENT * (n[p] + n[some] - both)].tolist():
                if ids[i] != ids[p]:
                    out.append((int(ids[p]), int(ids[i])))
                comp[comp == comp[i]] = comp[p]
    return out


def _linked(members: DataFrame) -> DataFrame:
    """Links (u, v) found in the groups; rows arrive sorted by group."""

    def run(batches):
        hashes = shingles.WordHashes()
        held: list[tuple] = []

        def solved():
            if len(held) < 2:
                return None
            key = held[0][0]
            ids, n = (np.array([r[i] for r in held], np.int64) for i in (2, 3))
            sig = np.frombuffer(b"".join(r[4] for r in held), np.uint16).reshape(-1, shingles.COMPONENTS)
            links = link_group(key & 63, ids, n, sig, _Sets([r[5] for r in held], hashes))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["u", "v"]) if links else None

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    if (links := solved()) is not None:
                        yield links
                    held = []
                held.append(row)
        if (links := solved()) is not None:
            yield links

    return members.mapInArrow(run, "u bigint, v bigint")


def _of_each_row(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Every row with component and pick of its class; ``named`` tells digest, copies, component and pick of every class.

    A class with more than one row in ``HOT`` is common. Fewer than ``HOT`` classes can be, so these few go to the rows, and no
    task gathers the rows of a common class. All other rows, and only these, are dealt by digest. Empty sets need no join.
    """
    total = named.agg(F.sum("copies")).first()[0] or 0
    own = ["doc_id", "t", "n_shingles"]
    common = F.broadcast(named.where(F.col("copies") * HOT > total).select("digest", "component", "pick"))
    full = rows.where("n_shingles > 0").select(*own, "digest")
    empty = rows.where("n_shingles = 0").select(*own, F.col("doc_id").cast("bigint").alias("component"), F.col("t").alias("pick"))
    rare = full.join(common, "digest", "left_anti").join(named.where(F.col("copies") * HOT <= total).select("digest", "component", "pick").hint("merge"), "digest")
    return full.join(common, "digest").drop("digest").unionByName(rare.drop("digest")).unionByName(empty)


def _numbered(classes: DataFrame) -> DataFrame:
    """The classes with a doc_id and a number ``no`` of each, in the order of their doc_ids: the id itself unless two classes share it."""
    live = classes.where("id IS NOT NULL")
    if live.groupBy("id").count().where("count > 1").isEmpty():
        return live.withColumn("no", F.col("id"))
    return stage(live.orderBy("id", "digest").withColumn("no", F.monotonically_increasing_id()))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles, component (smallest doc_id reachable) and pick of every row.

    pick is a hash of text: the text under the component's doc_id that stands for it, null in rows of its other classes.
    """
    rows = stage(sketches(docs))
    named_first = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("bigint").alias("id"), "t"))
    classes = stage(rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min(named_first).alias("_f"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
        .select("digest", "_f.id", "_f.t", "copies", "n", "signature"))
    live = _numbered(classes)
    grouped = stage(groups(live.select(F.col("no").alias("id"), "signature"))).withColumnRenamed("id", "no")
    wanted = grouped.select("no").distinct().join(live.select("no", "id", "t", "n", "signature").hint("merge"), "no")
    # copies under one id collapse before the shuffle
    packed = compress(docs).groupBy(F.col("doc_id").cast("bigint").alias("id"), "t").agg(F.first("packed").alias("packed")).join(wanted.hint("merge"), ["id", "t"])
    members = grouped.join(packed, "no").select("key", "part", F.col("no").alias("id"), "n", "signature", "packed")
    links = _linked(members.repartition("key", "part").sortWithinPartitions("key", "part", "id"))
    labels = components(links).withColumnRenamed("node", "no")
    # the component is found once for each class; classes are distinct texts, so no number is common here
    named = live.select("digest", "copies", "no", "id", "t").join(labels.hint("merge"), "no", "left").withColumn("label", F.coalesce("label", "no"))
    named = named.withColumn("pick", F.when(F.col("label") == F.col("no"), F.col("t")))
    if live.where("no <> id").isEmpty():
        named = named.withColumn("component", F.col("label"))
    else:  # numbers stand for ids
        named = named.join(live.select(F.col("no").alias("label"), F.col("id").alias("component")).hint("merge"), "label")
    named = named.select("digest", "copies", "component", "pick").unionByName(
        classes.where("id IS NULL").select("digest", "copies", F.col("id").alias("component"), F.col("t").alias("pick")))
    return _of_each_row(rows, stage(named))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id) of every row."""
    own, kind = F.col("doc_id"), dict(docs.dtypes)["doc_id"]
    return judged(docs).select(own, "n_shingles", F.col("component").cast(kind).alias("component_id")).withColumn("kept", own.eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of one text of each group, with all their columns; of rows that repeat its id and text, any one stays.

    Rows with a null doc_id stay: no group can name them.
    """
    mark = judged(docs).where("doc_id = component AND t = pick").select("doc_id", F.col("t").alias("_text_hash")).distinct()
    named = docs.withColumn("_text_hash", F.xxhash64("text")).join(mark, ["doc_id", "_text_hash"], "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
