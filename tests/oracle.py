"""Compare a DataFrame with the result of SQL in DuckDB over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value:.6g}" if abs(value) < 1e6 else f"{value:.9g}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs, empty if nothing does."""
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    theirs = rows_of(theirs_columns, cursor.fetchall())
    ours = rows_of(df.columns, df.collect())
    found = []
    if sorted(df.columns) != sorted(theirs_columns):
        found.append(f"columns {sorted(df.columns)} vs {sorted(theirs_columns)}")
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    for name, dtype in df.dtypes:
        if dtype in kinds and types.get(name) not in (kinds[dtype], None):
            found.append(f"type of {name}: {dtype} vs {types[name]}")
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows vs {len(theirs)}")
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if differing:
        a, b = differing[0]
        cells = [(x[:80], y[:80]) for x, y in zip(a, b) if x != y]
        found.append(f"{len(differing)} rows differ, first: {cells}")
    return found
