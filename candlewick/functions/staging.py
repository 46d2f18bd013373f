"""Cut a lineage by writing a table into the cluster's shared checkpoint folder.

A plan that reads one intermediate result several times would compute it several times. ``stage``
writes it once as Parquet and reads it back: every reader (and every retry after a lost executor)
sees the same rows, columns are pruned on read, and the optimizer knows the real size when it
decides whether a side may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder.

    Only a local master, where driver and executors are one process, gets a folder of its own if neither is set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="candlewick-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/candlewick/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
