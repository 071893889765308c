"""Side-by-side comparison of a Spark result with the SQL counterpart in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "item"):
        return _cell(value.item())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def differences(spark_frame, connection, sql: str) -> list[str]:
    """What differs, in words; empty where both sides agree."""
    mine = rows_of(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    relation = connection.sql(sql)
    theirs = rows_of(list(relation.columns), relation.fetchall())
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} and {theirs[0]}"]
    found = []
    if len(mine[1]) != len(theirs[1]):
        found.append(f"{len(mine[1])} and {len(theirs[1])} rows")
    if mine[1] != theirs[1]:
        left, right = set(map(repr, mine[1])), set(map(repr, theirs[1]))
        found.append(f"only in Spark: {[r[:300] for r in sorted(left - right)[:2]]}")
        found.append(f"only in SQL: {[r[:300] for r in sorted(right - left)[:2]]}")
    return found
