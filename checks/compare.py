"""Compare every query with its SQL: `python -m checks.compare [data folder] [name ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.spark_queries import QUERIES


def session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("pairlens")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable", ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = canonical(got), canonical(want)
    bad = []
    for c in got.columns:
        a, b = got[c], want[c]
        unequal = ~((a == b) | (a.isna() & b.isna()))
        if unequal.any():
            bad.append(f"{c}: {int(unequal.sum())} e.g. {a[unequal].iloc[0]!r:.80} / {b[unequal].iloc[0]!r:.80}")
        elif a.dtype != b.dtype and not (a.isna().any() or b.isna().any()):
            bad.append(f"{c}: type {a.dtype} / {b.dtype}")
    return "; ".join(bad)


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, failed = session(), duck(sf_dir), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            if name not in ORACLE:
                print(f"rows  {name:32} {len(got):8} rows {spent:7.1f} s", flush=True)
                continue
            start = time.time()
            want = con.execute(ORACLE[name]).df()
            problem = difference(got, want)
        except Exception as error:  # one broken query must not hide the others
            problem, spent, got = f"{type(error).__name__}: {str(error)[:700]}", time.time() - start, ()
        failed += bool(problem)
        print(f"{'FAIL ' if problem else 'ok   '} {name:32} {len(got):8} rows {spent:7.1f} s "
              f"sql {time.time() - start:6.1f} s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(bool(main(args[0], args[1:])))
