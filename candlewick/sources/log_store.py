"""Log lines with an index that tells which files a question has to open.

A store is one folder: ``lines`` holds the text as part files, ``files`` one manifest row per part (logical file, lines, entries, first
and last time, entries without a time of their own), ``trigrams`` a Bloom filter of every part's three-letter sequences. The filter is a
relation: 64-bit words by (word, part), zero words left out. So it is built by a grouped OR, no part's filter is ever gathered in one
buffer, and a question reads the few words that its text needs, sorted together on disk.

``add`` takes files the manifest does not know yet. Its three writes are committed in order, the manifest last: parts of an
interrupted call are in no manifest, are never read, and the next call adds their files anew. A part is skipped only if no entry of it
can match, so ``query`` returns what ``logs.query_entries`` returns over all lines. It may open a part in vain, never miss one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.staging import stage
from candlewick.sources import logs

# Bits of a part's filter and bits set per trigram; words of 64 bits.
FILTER_BITS, HASHES, WORD = 1 << 18, 2, 64
GRAM = 3
# More parts than this are not named one by one: the whole store is read and joined with them.
NAMED_PARTS = 10_000
_FILES = "batch string, file string, part string, path string, lines bigint, entries bigint, first timestamp, last timestamp, timeless bigint"


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) to the distinct (part, gram) of every batch: the sequences of GRAM characters, cut out of all texts at once."""
    for batch in batches:
        # log lines repeat themselves: every text of a part is cut once
        once = pa.Table.from_batches([batch]).group_by(["part", "text"]).aggregate([])
        texts, parts = once.column("text").to_pylist(), once.column("part").combine_chunks().dictionary_encode()
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        # places from which GRAM characters of the same text follow
        at = np.flatnonzero(np.arange(len(chars)) + GRAM <= np.repeat(np.cumsum(sizes), sizes))
        if not len(at):
            continue
        code = sum((chars[at + k] << np.uint64(21 * k) for k in range(GRAM)), np.uint64(0))  # a character has 21 bits
        grams, which = np.unique(code, return_inverse=True)
        found = np.unique(np.repeat(parts.indices.to_numpy().astype(np.int64), sizes)[at] * len(grams) + which)
        words = pa.array(["".join(chr((g >> 21 * k) & 0x1FFFFF) for k in range(GRAM)) for g in grams.tolist()])
        yield pa.RecordBatch.from_arrays([parts.dictionary.take(pa.array(found // len(grams))), words.take(pa.array(found % len(grams)))], names=["part", "gram"])


def _grams(texts: DataFrame) -> DataFrame:
    """The sequences of GRAM characters in the small letters of the texts (part, text); a part's gram may come from several tasks."""
    return texts.select("part", F.lower("text").alias("text")).mapInArrow(_distinct_grams, "part string, gram string")


def _words(grams: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``keys`` and ``gram`` to filter words: word, bits."""
    place = F.explode(F.array(*[F.pmod(F.xxhash64("gram", F.lit(k)), F.lit(FILTER_BITS)) for k in range(HASHES)]))
    spot = grams.select(*keys, place.alias("_at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_at") % WORD).cast("int"))
    return spot.groupBy(*keys, F.floor(F.col("_at") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _scan(spark: SparkSession, folder: str, parts: list[str] | None = None) -> DataFrame:
    """batch, file, part, line of the stored lines, or of the named parts."""
    root = f"{folder}/lines"
    where = [root] if parts is None else [f"{root}/{p}" for p in parts]
    tail = F.regexp_extract(F.col("_metadata.file_path"), "(batch=[^/]*/file=[^/]*/[^/]*)$", 1)
    read = spark.read.schema("value string, batch string, file string").option("basePath", root).option("lineSep", "\n").text(where)
    return read.select("batch", "file", tail.alias("part"), F.col("value").alias("line"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store; empty while nothing is stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: one row per part."""
    return _stored(spark, f"{folder}/files", _FILES)


def add(lines: DataFrame, folder: str) -> None:
    """Store and index the lines (path, line) of files that the store does not hold yet; a file comes as a whole, when it is closed."""
    spark, batch = lines.sparkSession, uuid.uuid4().hex
    fresh = logs.unprocessed(lines, files(spark, folder)).withColumn("file", F.left(F.sha2("path", 256), F.lit(32)))
    names = stage(fresh.select("file", "path").distinct())
    if names.isEmpty():
        return
    # files of any size: small ones share a task, a large one is cut
    (fresh.select(F.coalesce("line", F.lit("")).alias("value"), F.lit(batch).alias("batch"), "file").hint("rebalance", "file")
     .write.mode("append").partitionBy("batch", "file").option("lineSep", "\n").text(f"{folder}/lines"))
    rows = _scan(spark, folder).filter(F.col("batch") == batch).join(names, "file")
    # no time but its own: an undated entry gets the time of the question
    entries = stage(logs.parse_entries(rows, F.lit(None).cast("timestamp"), keep=("part",)).select("part", "timestamp", "event_type", "message"))  # read twice
    texts = entries.select("part", F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in ("message", "event_type")])).alias("text"))
    (_words(_grams(texts), "part").repartitionByRange("word", "part").sortWithinPartitions("word", "part")
     .write.mode("append").parquet(f"{folder}/trigrams"))
    ts = logs.parse_timestamp(F.col("timestamp"))
    known = entries.groupBy("part").agg(F.count(F.lit(1)).alias("entries"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_if(ts.isNull()).alias("timeless"))
    parts = rows.groupBy("batch", "file", "part", "path").agg(F.count(F.lit(1)).alias("lines"))
    zero = F.lit(0).cast("bigint")
    (parts.join(known, "part", "left").select("batch", "file", "part", "path", "lines", F.coalesce("entries", zero).alias("entries"), "first", "last",
                                              F.coalesce("timeless", zero).alias("timeless")).write.mode("append").parquet(f"{folder}/files"))


def candidates(spark: SparkSession, folder: str, system: str | None = None, time_from: Column | None = None, time_to: Column | None = None, text: str | None = None) -> DataFrame:
    """Manifest rows of the parts that may hold a matching entry."""
    out = files(spark, folder).filter("entries > 0")
    if system:
        out = out.filter(F.upper(logs.source_system(F.col("path"))) == system.upper())
    if time_from is not None:
        out = out.filter((F.col("timeless") > 0) | (F.col("last") >= time_from))
    if time_to is not None:
        out = out.filter((F.col("timeless") > 0) | (F.col("first") <= time_to))
    small = (text or "").lower()
    grams = sorted({small[i:i + GRAM] for i in range(len(small) - GRAM + 1)})
    if grams:
        asked = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in grams])).alias("gram"))
        need = _words(asked).collect()  # at most HASHES words per character of the question
        holds = F.lit(False)
        for r in need:
            holds = holds | ((F.col("word") == r.word) & (F.col("bits").bitwiseAND(F.lit(r.bits)) == r.bits))
        met = _stored(spark, f"{folder}/trigrams", "part string, word int, bits bigint").filter(F.col("word").isin([r.word for r in need])).filter(holds)
        out = out.join(met.groupBy("part").agg(F.count(F.lit(1)).alias("_met")).filter(F.col("_met") == len(need)), "part", "left_semi")
    return out


def open_lines(spark: SparkSession, folder: str, parts: DataFrame, named: int = NAMED_PARTS) -> DataFrame:
    """path, line of the given parts. Up to ``named`` parts only they are opened; more of them are joined with the whole store."""
    some = [r.part for r in parts.select("part").limit(named + 1).collect()]
    if not some:
        return spark.createDataFrame([], "path string, line string")
    rows = _scan(spark, folder, some if len(some) <= named else None)
    return rows.join(parts.select("part", "path"), "part").select("path", "line")


def query(spark: SparkSession, folder: str, level: str | None = None, system: str | None = None, time_from: Column | None = None, time_to: Column | None = None,
          text: str | None = None, now: Column | None = None, by_time: bool = True) -> DataFrame:
    """``logs.query_entries`` over the store, reading only parts that may match."""
    lines = open_lines(spark, folder, candidates(spark, folder, system, time_from, time_to, text))
    return logs.query_entries(logs.parse_entries(lines, now), level, system, time_from, time_to, text, by_time)
