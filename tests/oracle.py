"""Side-by-side comparison of a Spark query and its DuckDB oracle."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(norm(r[k]) for k in order) for r in data)


def compare(df, sql: str, sf_dir: str) -> tuple[int, str]:
    """Rows of the query, and what differs ('' if nothing)."""
    got = [tuple(r) for r in df.collect()]
    res = duck(sf_dir).execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a != b:
        return len(got), f"{len(got)} and {len(want)} rows; only Spark {list((a - b).items())[:2]}; only oracle {list((b - a).items())[:2]}"
    return len(got), ""
