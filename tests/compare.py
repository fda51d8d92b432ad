"""Compare a Spark result with DuckDB's, without regard to row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


# Column types that hold the same values on both sides.
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def type_differences(spark_df, con, sql: str) -> list[str]:
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    expected = {row[0]: TYPES.get(row[1], row[1]) for row in described}
    return [
        f"{name}: {kind} <> {expected.get(name)}"
        for name, kind in spark_df.dtypes
        if kind != expected.get(name)
    ]


def compare(spark_df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    told = type_differences(spark_df, con, sql)
    if told:
        return f"types {told}"
    left_columns, left = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right_columns, right = _sorted_rows(names, result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} <> {right_columns}"
    if len(left) != len(right):
        extra = sorted(set(left) - set(right), key=str)[:2], sorted(set(right) - set(left), key=str)[:2]
        return f"rows {len(left)} <> {len(right)}; only Spark {extra[0]}; only SQL {extra[1]}"
    for a, b in zip(left, right):
        if a != b:
            return f"{left_columns}: {a} <> {b}"
    return None if left else "no rows"
