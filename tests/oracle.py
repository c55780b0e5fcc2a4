"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def kind(v):
    return "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((kind(x), str(x)) if kind(x) != "number" else ("number", f"{x:+030.9f}") for x in r))


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    sql_columns, sql_rows = list(rel.columns), rel.fetchall()
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(sql_columns, sql_rows)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "both empty"
    for g, w in zip(got, want):
        if g != w:
            return f"{sorted(df.columns)}\n  got  {g}\n  want {w}"
    types = dict(zip(sql_columns, [str(t) for t in rel.types]))
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "float": "FLOAT", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    }
    off = {c: (t, types[c]) for c, t in mine.items() if same.get(t) != types[c]}
    return f"types {off}" if off else None
