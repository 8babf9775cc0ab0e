"""Run a query and its SQL side by side and compare the rows, in any order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def plain(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if value.__class__.__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(directory).glob("*.parquet")):
        source = str(path / "*.parquet") if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def differences(df, sql: str, con) -> str:
    """Empty if both give the same columns and rows."""
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if len(ours) != len(theirs):
        a, b = set(ours), set(theirs)
        return f"rows {len(ours)} and {len(theirs)}; only here {list(a - b)[:3]}; only there {list(b - a)[:3]}"
    bad = [(x, y) for x, y in zip(ours, theirs, strict=True) if x != y]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""
