"""What each filter of a chain removes, for every order of the chain, from sorted posting lists.

1. One row per document with its part, id and a bit for every filter it fails (and for good and toxic labels).
2. These rows are range-partitioned by (part, id) and sorted, so a source that holds a third of the table is
   many ranges. Of each range, the posting list of a filter is the sorted list of the positions that fail it.
3. In each range, the union of the lists of each of the 32 sets of filters is made by a galloping k-way merge, and the good and toxic
   documents outside the union by galloping differences. Their sizes are summed by part: 32 rows of sums.
4. All orders and steps follow from the sums, because what is left after a prefix of an order depends only on its set.

Positions are used instead of ids inside a range, so repeated and null ids count as documents of their own.

Defined cases: null text is empty (fails A, no words to repeat, no letters); a null part is the empty string; a document without label row is
neither good nor toxic, of several label rows one with the value suffices; null ids have no label and no smaller
id; repeated rows (same id and text) fail E only if a smaller id has the text; an empty table gives no rows; columns besides doc_id, text and the part are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.staging import stage
from candlewick.llm.exact_dedup import with_classes

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
GOOD, TOXIC = SETS, 2 * SETS


def content_failures(text: Column) -> list[Column]:
    """Failure of A to D by the text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("bigint") > 5 * F.length(text), F.regexp_like(text, F.lit("[#$%&*|]"))]


def _bits(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, id, row (unique) and bits: filters failed, good, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), _bits(content_failures(text)).alias("content"))
    copy = F.when(F.col("smallest") < F.col("id"), F.lit(1 << 4)).otherwise(F.lit(0))
    judged = stage(with_classes(rows).select("part", "id", F.monotonically_increasing_id().alias("row"), F.col("content").bitwiseOR(copy).alias("bits")))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("toxic"))
    marked = judged.where("id IS NOT NULL").join(marks, "id", "left").select(
        "part", "id", "row", F.col("bits").bitwiseOR(F.coalesce("good", F.lit(0))).bitwiseOR(F.coalesce("toxic", F.lit(0))).alias("bits"))
    return marked.unionByName(judged.where("id IS NULL"))


def _gallop(ids: list[int], at: int, value: int) -> int:
    """The first position from ``at`` on whose id is not below ``value``: doubling steps, then a binary search."""
    step, end = 1, len(ids)
    while at + step < end and ids[at + step] < value:
        at += step
        step *= 2
    return bisect_left(ids, value, at, min(at + step + 1, end))


def union(lists: list[list[int]]) -> list[int]:
    """Sorted union of sorted lists: the list with the smallest head gives its whole run below the next head."""
    live = [[ids, 0] for ids in lists if ids]
    out: list[int] = []
    while len(live) > 1:
        live.sort(key=lambda e: e[0][e[1]])
        (ids, at), (other, there) = live[0], live[1]
        stop = other[there]
        to = _gallop(ids, at, stop)
        out += ids[at:to]
        live[0][1] = to + (to < len(ids) and ids[to] == stop)  # an id in both stays with the other list
        if live[0][1] == len(ids):
            del live[0]
    return out + live[0][0][live[0][1]:] if live else out


def difference(ids: list[int], without: list[int]) -> list[int]:
    """Sorted ids that ``without`` lacks, by galloping in both lists."""
    out, i, j = [], 0, 0
    while i < len(ids):
        j = _gallop(without, j, ids[i])
        if j == len(without):
            return out + ids[i:]
        if without[j] == ids[i]:
            i += 1
        else:
            to = _gallop(ids, i, without[j])
            out += ids[i:to]
            i = to
    return out


def _range_sums(part: str | None, bits: np.ndarray) -> Iterator[tuple]:
    lists = [np.flatnonzero(bits & (1 << f)).tolist() for f in range(len(FILTERS))]
    good, toxic = (np.flatnonzero(bits & m).tolist() for m in (GOOD, TOXIC))
    for s in range(SETS):
        gone = union([ids for f, ids in enumerate(lists) if s >> f & 1])
        yield part, s, len(bits), len(gone), len(good) - len(difference(good, gone)), len(toxic) - len(difference(toxic, gone))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.string()), ("set", pa.int32()), *[(c, pa.int64()) for c in ("n", "gone", "good", "toxic")]])
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column("part").dictionary_encode()
        part, bits = code.indices.to_numpy(), b.column("bits").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        rows = [r for a, z in zip(cuts, cuts[1:], strict=False) for r in _range_sums(code.dictionary[part[a]].as_py(), bits[a:z])]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def set_sums(failed: DataFrame) -> DataFrame:
    """part, n and, for each set of filters, the documents (all, good, toxic) that fail one of them, as an array by set."""
    ranges = failed.repartitionByRange("part", "id", "row").sortWithinPartitions("part", "id", "row").select("part", "bits")
    sums = ranges.mapInArrow(_postings, "part string, set int, n bigint, gone bigint, good bigint, toxic bigint")
    by_set = sums.groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in ("n", "gone", "good", "toxic")])
    return by_set.groupBy("part").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("set", "gone", "good", "toxic"))).alias("sets"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(FILTERS[x] for x in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(f).alias("f"), F.lit(before).alias("before")))
            before |= 1 << f
    gone = lambda s: F.col("sets")[s]["gone"]
    # over all orders, a filter meets each set without it |set|! (4 - |set|)! times
    times = [24, 6, 4, 6, 24]
    shapley = F.array(*[sum((times[bin(s).count("1")] * (gone(s | 1 << f) - gone(s)) for s in range(SETS) if not s >> f & 1), F.lit(0)) for f in range(len(FILTERS))])
    only = F.array(*[gone(SETS - 1) - gone(SETS - 1 - (1 << f)) for f in range(len(FILTERS))])
    table = set_sums(failures(docs, labels, part)).withColumns({"shapleys": shapley, "only": only})
    each = table.select("part", "n", "sets", "shapleys", "only", F.inline(F.array(*steps)))
    bit = F.expr("shiftleft(1, f)")
    each = each.withColumns({"was": F.expr("sets[before]"), "now": F.col("sets")[F.col("before").bitwiseOR(bit)], "alone": F.col("sets")[bit]["gone"]})
    removed = F.col("now.gone") - F.col("was.gone")
    return each.select("part", "filter_order", "step", (F.col("n") - F.col("now.gone")).alias("kept"), removed.alias("removed"), (F.col("alone") - removed).alias("redundant"),
                       F.expr("only[f]").alias("unique_fails"), (F.col("now.good") - F.col("was.good")).alias("good_lost"), (F.col("now.toxic") - F.col("was.toxic")).alias("toxic_lost"),
                       F.expr("shapleys[f]").alias("shapley"))
