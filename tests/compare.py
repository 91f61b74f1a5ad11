"""Compare a Spark result with a DuckDB result, order-insensitive, by column name."""

from __future__ import annotations

import math

import duckdb

from qaspark.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 9) + 0.0
        return int(value) if value == int(value) else value
    if isinstance(value, bool):
        return value
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in records), key=repr)


def difference(df, db, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows(names, result.fetchall())
    actual = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}"
    bad = [(a, e) for a, e in zip(actual, expected) if a != e]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
