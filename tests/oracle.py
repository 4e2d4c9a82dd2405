"""Run a query's SQL in DuckDB over the same files and compare, as the correctness check does."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM read_parquet('{at}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "dtype"):
        return str([_plain(x) for x in v])
    if hasattr(v, "tolist"):
        v = v.tolist()
        return str([_plain(x) for x in v]) if isinstance(v, list) else _plain(v)
    if isinstance(v, bool):
        return str(v)
    try:
        from decimal import Decimal

        if isinstance(v, Decimal):
            return f"{float(v):.9g}"
    except ImportError:
        pass
    return str(v)


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if both have the same columns, kinds of columns and rows."""
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows(names, res.fetchall()), rows(df.columns, df.collect())
    if want == have:
        return ""
    a, b = [x for x in have if x not in set(want)], [x for x in want if x not in set(have)]
    return f"{len(have)} rows, oracle {len(want)}; only here {a[:3]}; only there {b[:3]}"
