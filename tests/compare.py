"""Rows of a Spark query against rows of its SQL twin in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path


def cell(x):
    """A value that compares equal in both engines: floats to nine significant digits, nested values as text."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "asDict"):
        return cell(x.asDict())
    if isinstance(x, dict):
        return str({k: cell(v) for k, v in sorted(x.items())})
    if isinstance(x, (list, tuple)):
        return str([cell(v) for v in x])
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, ours = spark_rows(df)
    other_names, theirs = duck_rows(sql, sf_dir)
    assert names == other_names
    assert len(ours) == len(theirs), f"{len(ours)} rows, {len(theirs)} expected"
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, dict(zip(names, zip(a, b, strict=True), strict=True))
