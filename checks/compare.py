"""Run the catalog against its SQL and report differences."""

from __future__ import annotations

import math

import duckdb

INPUTS = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in INPUTS:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    plain = [tuple(_plain(row[at]) for at in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((value is None, str(type(value)), value if value is not None else 0) for value in row))


def difference(connection, sql: str, frame) -> str | None:
    """None when the query and the SQL agree bit by bit, else what differs."""
    result = connection.execute(sql)
    sql_columns = [column[0] for column in result.description]
    if sorted(sql_columns) != sorted(frame.columns):
        return f"columns {sorted(sql_columns)} != {sorted(frame.columns)}"
    expected = sorted_rows(sql_columns, result.fetchall())
    found = sorted_rows(frame.columns, frame.collect())
    if len(expected) != len(found):
        return f"{len(expected)} rows expected, {len(found)} found"
    for left, right in zip(expected, found):
        if left != right:
            return f"expected {left}, found {right}"
    return None
