"""A content-addressed web archive.

The archive is two tables in a shared folder. ``payloads`` stores every distinct payload once, under its
SHA-256; ``headers`` holds the exact header block of every record. A record is its header joined with the payload
its header names. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the smallest
page_id is the response, the others revisit it and carry no payload; smaller payloads are always responses.

Writing shuffles each distinct payload once (copies inside a task collapse before the shuffle), headers go by
digest with a few hundred bytes each. Reading verifies: the digest of every stored payload is computed again.

Defined cases: null html is an empty payload; a null url is an empty target, line breaks in it are
percent-encoded; rows with a null page_id are never referred to and revisit the others if there are any;
rows that repeat the smallest page_id are all responses; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.staging import shared_folder

REVISIT_BYTES = 100
# The records' fixed date: the tables have no fetch time, and reruns must agree.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def header_block() -> Column:
    """The exact header of a record, with its closing empty line."""
    page, first = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "_first"))
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("_revisit")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), first, F.lit(">"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("_bytes").cast("string"))), F.lit("\r\n"))


def write_archive(pages: DataFrame, folder: str) -> None:
    """Write ``folder``/payloads and ``folder``/headers."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    (full.groupBy("digest").agg(F.min("page_id").alias("_first"), F.first("payload").alias("payload"))
     .select("digest", "_first", F.length("payload").cast("bigint").alias("_bytes"), "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads"))
    store = pages.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "_first", "_bytes")
    light = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"))
    records = light.join(store, "digest").withColumn(
        "_revisit", (F.col("_bytes") >= REVISIT_BYTES) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")))
    records.select("digest", header_block().alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?dm)^{name}: ([^\r]*)\r$", 1)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, from its header and the stored payload it names; fails if a payload does not have its digest."""
    page = lambda name: F.nullif(F.regexp_extract(_field(name), "^<urn:page:(.*)>$", 1), F.lit(""))
    headers = spark.read.parquet(f"{folder}/headers").select(
        page("WARC-Record-ID").cast("bigint").alias("page_id"), F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("digest"),
        _field("WARC-Type").alias("record_type"), page("WARC-Refers-To").cast("bigint").alias("refers_to"), F.col("header"))
    store = spark.read.parquet(f"{folder}/payloads").select("digest", F.sha2("payload", 256).alias("_now"), F.length("payload").cast("bigint").alias("payload_bytes"))
    sound = store.select("digest", F.when(F.col("_now") == F.col("digest"), F.col("_now")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("payload_digest"), "payload_bytes")
    return headers.join(sound, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "header")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """page_id and the exact bytes of its record: header, payload (none for revisits), two line ends."""
    headers = spark.read.parquet(f"{folder}/headers").withColumn("page_id", F.nullif(F.regexp_extract(_field("WARC-Record-ID"), "^<urn:page:(.*)>$", 1), F.lit("")).cast("bigint"))
    revisit, end = _field("WARC-Type") == "revisit", F.lit("\r\n\r\n").cast("binary")
    short = headers.where(revisit).select("page_id", F.concat(F.col("header").cast("binary"), end).alias("record"))
    full = headers.where(~revisit).join(spark.read.parquet(f"{folder}/payloads").select("digest", "payload"), "digest")
    return short.unionByName(full.select("page_id", F.concat(F.col("header").cast("binary"), F.col("payload"), end).alias("record")))


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archive of ``pages`` and read it back; without a folder, one in the session's shared folder."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, folder)
    return read_archive(spark, folder)
