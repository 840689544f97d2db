"""Runs registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_canon(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    """None when equal, otherwise what differs."""
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(oracle_df.columns)}"
    if len(spark_df) != len(oracle_df):
        return f"rows {len(spark_df)} vs {len(oracle_df)}"
    for c in spark_df.columns:
        a, b = spark_df[c].dtype, oracle_df[c].dtype
        if a != b and len(spark_df) and not (spark_df[c].isna().any() or oracle_df[c].isna().any()):
            if not (str(a).startswith("datetime") and str(b).startswith("datetime")):
                return f"type of {c}: {a} vs {b}"
    # A nullable integer column is float in one frame and Int64 in the other.
    for c in spark_df.columns:
        if spark_df[c].dtype != oracle_df[c].dtype and pd.api.types.is_numeric_dtype(oracle_df[c].dtype):
            spark_df[c] = spark_df[c].astype("float64")
            oracle_df[c] = oracle_df[c].astype("float64")
    x, y = canonical(spark_df), canonical(oracle_df)
    for r, s in zip(x, y):
        if r != s:
            return f"values {r} vs {s} (columns {sorted(spark_df.columns)})"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf = os.environ.get("SF", "0.01")
    names = sys.argv[1:]
    d = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(d)
    oracles = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, d).toPandas()
            t1 = time.time()
            if name in oracles:
                why = compare(got, con.execute(oracles[name]).df())
            else:
                why = None if len(got) else "no rows"
        except Exception as e:  # noqa: BLE001
            t1, got, why = time.time(), [], f"{type(e).__name__}: {str(e)[:600]}"
        bad += why is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if why else 'ok':5}{name:32}{kind:7}{len(got):8} {t1 - t0:6.2f}s {why or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
