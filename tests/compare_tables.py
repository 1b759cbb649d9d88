"""Run a registered query and its SQL twin and compare all rows."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What the two results differ in; empty if they agree."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = _rows(names, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for field in df.schema.fields:
        if SAME.get(field.dataType.simpleString()) != types[field.name]:
            found.append(f"type of {field.name}: {field.dataType.simpleString()} vs {types[field.name]}")
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} vs {len(expected)}")
    if actual != expected:
        ours, theirs = set(map(repr, actual)), set(map(repr, expected))
        found.append(f"only spark: {sorted(ours - theirs)[:2]}"[:1500])
        found.append(f"only sql: {sorted(theirs - ours)[:2]}"[:1500])
    return found
