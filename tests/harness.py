"""Compare registered queries with their SQL on DuckDB: ``python tests/harness.py [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        if pd.api.types.is_numeric_dtype(df[name]):
            df[name] = df[name].astype("float64").round(6) + 0.0
        df[name] = df[name].astype(object).where(df[name].notna(), None).map(lambda v: repr(v) if v is not None else "~")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    kinds = [
        (n, got[n].dtype, want[n].dtype)
        for n in got.columns
        if pd.api.types.is_numeric_dtype(got[n]) != pd.api.types.is_numeric_dtype(want[n]) and got[n].notna().any()
    ]
    if kinds:
        return f"types {kinds}"
    a, b = canonical(got), canonical(want)
    bad = (a != b).any(axis=1)
    if bad.any():
        both = pd.concat([a[bad].head(3), b[bad].head(3)], keys=["spark", "sql"])
        return f"{int(bad.sum())} of {len(a)} rows differ\n{both.to_string()}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name:28s} {len(got):8d} rows {took:6.1f}s", flush=True)
                if len(names) < 4:
                    print(got.head(20).to_string())
                continue
            start = time.time()
            want = con.sql(oracles[name]).df()
            problem = difference(got, want)
            state = "FAIL" if problem else "ok"
            failed += bool(problem)
            print(f"{state:5s} {name:28s} {len(got):8d} rows {took:6.1f}s  sql {time.time() - start:5.1f}s {problem or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name}: {str(e)[:900]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
