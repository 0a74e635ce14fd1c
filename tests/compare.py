"""Runs registered queries in Spark and their SQL in DuckDB and compares rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool | int | str) or value is None:
        return value
    if hasattr(value, "isoformat"):
        return str(value)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else str(value)


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, '' if nothing does."""
    wanted = con.execute(sql)
    names = [d[0] for d in wanted.description]
    want = rows(names, wanted.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows(df.columns, df.collect())
    if got == want:
        return ""
    lost, extra = [r for r in want if r not in set(got)][:3], [r for r in got if r not in set(want)][:3]
    return f"{len(got)} rows and {len(want)}; only in Spark {extra}; only in SQL {lost}"
