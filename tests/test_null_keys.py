"""Rows with a NULL key or a NULL chunk stay, as they would in a plain window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewick.functions import ordered


def rows(spark):
    return spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 5.0), (None, 2, 7.0), ("a", None, 9.0)], "k string, t int, x double")


def test_index_rows(spark):
    got = ordered.index_rows(rows(spark), ["k"], [F.col("t")], F.floor(F.col("t") / 2))
    want = rows(spark).withColumn("row_no", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert sorted(map(tuple, got.select("k", "t", "x", "row_no").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_running(spark):
    got = ordered.running(rows(spark), ["k"], ["t"], F.floor(F.col("t") / 2), {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))})
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = rows(spark).select("k", "t", F.sum("x").over(w).alias("s"), F.max("x").over(w).alias("m"))
    assert sorted(map(tuple, got.select("k", "t", "s", "m").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
