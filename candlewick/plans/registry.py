"""Registry of named queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query; ``sql`` is the equivalent DuckDB statement, if there is one.

    ``dates`` are date columns, handed out as text on both sides.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = fn(spark, sf_dir)
            return out.withColumns({c: out[c].cast("string") for c in dates}) if dates else out

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            casts = ", ".join(f'"{c}"::VARCHAR AS "{c}"' for c in dates)
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if dates else sql
        return fn

    return add
