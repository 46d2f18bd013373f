"""Mixing sources to target weights by a low-discrepancy schedule.

* Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the words of all
  documents. No target exceeds ``MAX_PASSES`` times its source; what is over goes to the others by weight. In the
  order of cap over weight this is one running sum over the sources.
* Blocks: the documents of a source are shuffled by hash and laid end to end; its words are cut into blocks of
  ``BLOCK_WORDS``. Positions are a sum inside chunks of about ``CHUNK_DOCS`` documents plus the sums of earlier
  chunks, so no task holds a source, however hot.
* Schedule: slot i takes the i-th van der Corput point (its bits mirrored) to the source whose interval of
  cumulative block shares holds the point. The rank of a slot within its source (again by chunks) names
  pass and block. A source whose slots run short gets its missing ranks appended; ranks beyond its target stay
  empty, and the last block of a source is cut, so every source meets its target to the word.
* Documents join the blocks that hold their words. ``sequence`` gives the mix itself, one row for each use of a document's words, with the
  slot it comes from: read in slot order, any stretch holds the sources by their shares. ``mix`` sums up by document: the words taken, the
  number of uses, and the first slot, by which the pipeline's output is ordered.

The tables of one row per source are ordered as a whole; all else is split by row count.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own;
repeated rows are documents of their own; an empty table gives an empty mix; further columns are ignored
unless asked for with ``carry``. Reruns over the same rows agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.staging import stage

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
BLOCK_WORDS = 1024
CHUNK_DOCS = 500
CHUNK_SLOTS = 2048
POINT_BITS = 40
_BUCKET_BITS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: key, source, docs, source_size, target, quota (whole words), blocks, ranks."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in WEIGHTS])
    t = per.withColumn("key", F.row_number().over(order) - 1).withColumn("_w", F.get(w, F.col("key") % len(WEIGHTS))).withColumn(
        "_cap", MAX_PASSES * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "key")
    before, rest, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    t = t.withColumn("_level", level).withColumn("_pos", F.row_number().over(by_ratio))
    free = F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.struct("_pos", "_level"))
    t = t.withColumn("_free", F.min(free).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_free._level") * F.col("_w"), F.col("_cap")))
    t = t.withColumn("target", target).withColumn("quota", F.least(F.round("target").cast("bigint"), MAX_PASSES * F.col("source_size")))
    up = lambda a: F.ceil(a / F.lit(block_words)).cast("bigint")
    full = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0))
    t = t.withColumn("blocks", up(F.col("source_size"))).withColumn("_full", full).withColumn("_rest", F.col("quota") - F.col("_full") * F.col("source_size"))
    return t.select("key", "source", "docs", "source_size", "target", "quota", "blocks", "_full", "_rest",
                    (F.col("_full") * F.col("blocks") + up(F.col("_rest"))).alias("ranks"))


def van_der_corput(i: Column) -> Column:
    """The bits of a slot number mirrored, as an integer below 2**POINT_BITS."""
    return F.conv(F.reverse(F.lpad(F.bin(i), POINT_BITS, "0")), 2, 10).cast("bigint")


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, key, rank, pass, block, words: which block of which source each slot takes. Appended ranks have slots behind all others."""
    spark = plan.sparkSession
    slots = plan.agg(F.coalesce(F.sum("ranks"), F.lit(0)).alias("n")).first()["n"]
    upto = F.sum("ranks").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    point = lambda c: F.floor(c.cast("decimal(38,0)") * F.lit(1 << POINT_BITS) / F.lit(max(slots, 1))).cast("bigint")
    cut = plan.withColumn("_hi", upto).select("key", point(F.col("_hi") - F.col("ranks")).alias("_lo"), point(F.col("_hi")).alias("_hi"))
    shift = POINT_BITS - _BUCKET_BITS
    cut = cut.where("_hi > _lo").withColumn("_bucket", F.explode(F.sequence(F.shiftright("_lo", shift), F.shiftright(F.col("_hi") - 1, shift))))
    points = spark.range(slots).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("_v")).withColumn("_bucket", F.shiftright("_v", shift))
    hits = points.join(cut, "_bucket").where("_v >= _lo AND _v < _hi").select("slot", "key").withColumn("_chunk", F.expr(f"slot div {CHUNK_SLOTS}"))
    counts = hits.groupBy("key", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select("key", "_chunk", "_from")
    local = Window.partitionBy("key", "_chunk").orderBy("slot")
    ranked = hits.withColumn("_r", F.row_number().over(local) - 1).join(starts, ["key", "_chunk"]).select("slot", "key", (F.col("_from") + F.col("_r")).alias("rank"))
    have = counts.groupBy("key").agg(F.sum("_n").alias("_have"))
    short = plan.join(have, "key", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where("_have < ranks")
    more = short.select("key", F.explode(F.sequence(F.col("_have"), F.col("ranks") - 1)).alias("rank")).select((F.col("rank") + slots).alias("slot"), "key", "rank")
    uses = ranked.unionByName(more).join(plan.select("key", "ranks", "blocks", "_full", "_rest", "source_size"), "key").where("rank < ranks")
    uses = uses.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    limit = F.when(F.col("pass") < F.col("_full"), F.col("source_size")).otherwise(F.col("_rest"))
    words = F.least((F.col("block") + 1) * block_words, limit) - F.col("block") * block_words
    whole = F.least((F.col("block") + 1) * block_words, F.col("source_size")) - F.col("block") * block_words
    return uses.select("slot", "key", "rank", "pass", "block", words.alias("words"), (words == whole).alias("whole"))


def _laid(sizes: DataFrame, plan: DataFrame, block_words: int) -> DataFrame:
    """The pieces of documents in blocks: words _a to _b of a block (null for documents without words)."""
    keyed = sizes.join(plan.select(F.col("source").alias("_s"), "key", "docs", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    keyed = keyed.withColumn("_h", F.xxhash64("doc_id", "size")).withColumn("_chunk", F.pmod(F.col("_h"), F.ceil(F.col("docs") / CHUNK_DOCS)))
    sums = keyed.groupBy("key", "_chunk").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    local = Window.partitionBy("key", "_chunk").orderBy("_h", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    laid = keyed.withColumn("_at", F.coalesce(F.sum("size").over(local), F.lit(0))).join(starts, ["key", "_chunk"]).withColumn("_at", F.col("_from") + F.col("_at"))
    first, last = F.expr(f"_at div {block_words}"), F.expr(f"(_at + size - 1) div {block_words}")
    pieces = laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    base = F.col("block") * block_words
    return pieces.withColumn("_a", F.greatest("_at", base) - base).withColumn("_b", F.least(F.col("_at") + F.col("size"), base + block_words) - base)


def _sized(docs: DataFrame, cols: list[str]) -> DataFrame:
    return stage(docs.select(*cols, n_words(F.col("text")).alias("_size"), F.monotonically_increasing_id().alias("_row")))


def sequence(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as a sequence: slot, source, doc_id, from_word and words (of the document) of every use, in any order; order by slot."""
    rows = _sized(docs, ["doc_id", "source"])
    sizes = rows.select("_row", "doc_id", "source", F.col("_size").alias("size"))
    plan = stage(targets(sizes, block_words).coalesce(1))
    uses = schedule(plan, block_words).select("slot", "key", "block", "words")
    base = F.col("block") * block_words
    used = _laid(sizes, plan, block_words).join(uses, ["key", "block"]).withColumn("words", F.least("_b", "words") - F.col("_a")).where("words > 0")
    named = used.join(plan.select("key", "source"), "key")
    return named.select("slot", "source", "doc_id", (base + F.col("_a") - F.col("_at")).alias("from_word"), "words")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, uses (slots that hold words of it), first_slot and the ``carry`` columns of every document."""
    cols = list(dict.fromkeys(("doc_id", "source", *carry)))
    rows = _sized(docs, cols)
    sizes = rows.select("_row", "doc_id", "source", F.col("_size").alias("size"))
    plan = stage(targets(sizes, block_words).coalesce(1))
    # at most one use of a block is cut, that of the last pass
    uses = schedule(plan, block_words).groupBy("key", "block").agg(
        F.count_if("whole").alias("_times"), F.min(F.when(F.col("whole"), F.col("slot"))).alias("_first"),
        F.coalesce(F.max(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("_part"), F.min(F.when(~F.col("whole"), F.col("slot"))).alias("_last"))
    pieces = _laid(sizes, plan, block_words)
    part = F.greatest(F.lit(0), F.least("_b", "_part") - F.col("_a"))
    in_part = F.col("_part") > F.col("_a")
    used = pieces.join(uses, ["key", "block"], "left").groupBy("_row", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("_times") * (F.col("_b") - F.col("_a")) + part), F.lit(0)).cast("bigint").alias("taken"),
        F.coalesce(F.sum(F.col("_times") + in_part.cast("int")), F.lit(0)).cast("bigint").alias("uses"),
        F.min(F.least("_first", F.when(in_part, F.col("_last")))).alias("first_slot"))
    if not carry:
        return used.drop("_row")
    rest = [c for c in cols if c != "doc_id"]
    return used.join(rows.select("_row", *rest), "_row").select(*cols, "size", "source_size", "target", "taken", "uses", "first_slot")
