"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
SCAN_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow_batches(spark: SparkSession) -> None:
    """Texts may be long: hand Python few rows at a time. Changes batching only, never a result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns an operator needs, and no other: clashing names of further columns never meet ours."""
    return docs.select(*[F.col(c) for c in dict.fromkeys(("doc_id", *keep, "text"))])


def per_row(docs: DataFrame, schema: str, make: Callable[[], Callable[[object, str], tuple]]) -> DataFrame:
    """Apply a function of (doc_id, text) to every row, without a shuffle; null text arrives as ''.

    ``make`` runs once in each task and returns the function, which returns the output row.
    """
    narrow_batches(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            rows = [fn(i, t or "") for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    return texts(docs).mapInArrow(run, schema)


def doc_id_type(docs: DataFrame) -> str:
    return dict(docs.dtypes)["doc_id"]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
