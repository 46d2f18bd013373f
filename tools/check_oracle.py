"""Run registered queries next to their DuckDB twins: python tools/check_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cpus: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("candlewick-check")
            .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "12g")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            df[c] = s.astype(str)
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.astype("datetime64[us]").astype(str).replace("NaT", "NULL")
        elif pd.api.types.is_float_dtype(s):
            df[c] = s.map(lambda v: "NULL" if pd.isna(v) else repr(float(v) + 0.0))
        else:
            df[c] = s.map(lambda v: "NULL" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and pd.isna(v))
                          else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


SPENT = [0.0]


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    SPENT[0] = time.time() - t0
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}", len(got)
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}", len(got)
    g, w = normal(got), normal(want)
    if g.equals(w):
        return "ok", len(got)
    bad = [c for c in g.columns if not g[c].equals(w[c])]
    at = (g[bad[0]] != w[bad[0]]).idxmax()
    return f"VALUES {bad} e.g. {g.loc[at].to_dict()} vs {w.loc[at].to_dict()}", len(got)


def main():
    from candlewick.plans import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = []
    for name, fn in QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            if name in ORACLES:
                verdict, n = compare(spark, con, fn, ORACLES[name], sf_dir)
            else:
                n = fn(spark, sf_dir).count()
                verdict = "rows-only"
        except Exception as e:  # noqa: BLE001
            verdict, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        if verdict not in ("ok", "rows-only"):
            failed.append(name)
        print(f"{name:34s} {n:8d} {SPENT[0]:6.1f}s of {time.time() - t0:6.1f}s {verdict}", flush=True)
    print("FAILED:", failed)


if __name__ == "__main__":
    main()
