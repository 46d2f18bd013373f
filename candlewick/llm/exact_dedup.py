"""Exact duplicates, combined in three steps so that no group of copies gathers in one task.

1. *Locally*: copies inside a map task collapse before the shuffle (the partial aggregate).
2. *Salted*: what the tasks keep is merged by (digest, salt, text); the salt is the task's number modulo
   ``SALTS``, so the winners of a common text are dealt to that many reducers.
3. *Globally*: at most ``SALTS`` winners of each text meet.

The text is a grouping key of every step, so texts are equal only if their whole content is; the digest merely
deals rows out. Documents then find their class by the digest alone where one text has it, by digest and text where
several have (with SHA-256 there are none; a shorter digest may be given). Classes with more than one row in
``COMMON`` are fewer than ``COMMON`` and are broadcast; only rows of the others are shuffled, with the digest and without the text.

Defined cases: null text counts as empty. Null ids are smaller than any id: they never stay unless all ids of the group
are null (then all its rows count as kept, with a null keep_id). Rows that repeat both id and text are one document: all carry
kept = true if their id stays; ``deduplicated`` returns one of them, that with the largest JSON form. Equal ids with other texts belong to
other groups. An empty table gives an empty result. Columns besides doc_id and text are ignored (``deduplicated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.staging import stage

SALTS = 64
COMMON = 16384


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _by_text(rows: DataFrame) -> DataFrame:
    """(digest, text) with the smallest and largest id and the number of rows, dealt by digest."""
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    merged = salted.groupBy("digest", "salt", "text").agg(F.min("id").alias("smallest"), F.max("id").alias("largest"), F.count(F.lit(1)).alias("n"))
    return merged.repartition("digest").groupBy("digest", "text").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))


def with_classes(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Each row of ``rows`` (columns id, text and others) without its text, with smallest, largest and n of the rows of equal text.

    The column ``digest`` is added; it must not exist yet.
    """
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", digest(F.col("text")))
    light = stage(rows.drop("text"))
    classes = stage(_by_text(rows.select("id", "text", "digest")).groupBy("digest").agg(
        F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")))
    total, most = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("texts"), F.lit(0))).first()
    common = F.broadcast(classes.where((F.col("n") * COMMON > total) & (F.col("texts") == 1)).drop("texts"))
    rest = classes.where((F.col("n") * COMMON <= total) & (F.col("texts") == 1)).drop("texts")
    out = light.join(common, "digest").unionByName(light.join(common, "digest", "left_anti").join(rest.hint("merge"), "digest"))
    if most > 1:  # texts that share a digest: told apart by their content
        shared = rows.join(classes.where("texts > 1").select("digest"), "digest", "left_semi")
        out = out.unionByName(shared.join(_by_text(shared.select("id", "text", "digest")), ["digest", "text"]).drop("text"))
    return out


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] = lambda c: c, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id (the largest id of equal text), group_size, kept, text_sha256."""
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("text"))
    if digest is not sha256:
        rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    named = F.lower(F.hex("digest")) if digest is sha256 else F.col("sha")
    return with_classes(rows, digest).select(F.col("id").alias("doc_id"), F.col("largest").alias("keep_id"), F.col("n").alias("group_size"),
                                             F.col("id").eqNullSafe(F.col("largest")).alias("kept"), named.alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text"), whole.alias("row"))
    kept = with_classes(rows).where(F.col("id").eqNullSafe(F.col("largest")))
    once = kept.groupBy("digest").agg(F.max_by("row", F.to_json("row")).alias("row"))
    return once.select("row.*")
