"""Run every registered query next to its reference SQL: ``python tests/oracle_check.py [sf] [names...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    text = df.map(lambda v: "∅" if pd.isna(v) else (repr(round(float(v), 6) + 0.0) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    cols = [c for c in a.columns if (a[c] != b[c]).any()]
    return f"{bad.sum()} rows differ in {cols}:\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from spatiofuse.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            spent = time.time() - start
            if name not in oracles:
                print(f"ROWS {name}: {len(got)} rows {spent:.1f}s", flush=True)
                continue
            start = time.time()
            why = difference(got, con.execute(oracles[name]).df())
            print(f"{'OK  ' if why is None else 'DIFF'} {name}: {len(got)} rows {spent:.1f}s (sql {time.time() - start:.1f}s)" + (f"\n{why}" if why else ""), flush=True)
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
            print(f"FAIL {name}: {why}", flush=True)
        if why:
            failed.append(name)
    print("failed:", failed)
