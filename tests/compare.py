"""Runs a named query and its SQL over the same tables and compares rows, names and values."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr), {n: t for n, t in df.dtypes}


def rows_of_sql(con, sql):
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    types = {d[0]: str(d[1]) for d in got.description}
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr), types
