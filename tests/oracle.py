"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

``python tests/oracle.py SF_DIR [name ...]`` checks from the command line.
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value: object) -> object:
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def order(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)


def spark_rows(frame) -> tuple[list[str], list[str], list[tuple]]:
    columns = sorted(frame.columns)
    types = [dict(frame.dtypes)[c] for c in columns]
    return columns, types, sorted((tuple(plain(v) for v in r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()), key=order)


def sql_rows(connection, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    places = sorted(range(len(names)), key=lambda i: names[i])
    types = [str(cursor.description[i][1]).lower() for i in places]
    return [names[i] for i in places], types, sorted((tuple(plain(r[i]) for i in places) for r in cursor.fetchall()), key=order)


def difference(frame, connection, sql: str) -> str | None:
    """What differs first, or nothing."""
    columns, types, left = spark_rows(frame)
    names, sql_types, right = sql_rows(connection, sql)
    if columns != names:
        return f"columns {columns} != {names}"
    known = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
    for name, mine, other in zip(columns, types, sql_types):
        if known.get(mine, other) != other:
            return f"type of {name}: {mine} != {other}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"{columns}: {a} != {b}"
    return None


def main() -> None:
    import logging

    logging.disable(logging.WARNING)
    from __spark_entry__ import oracle_sql, queries

    from keyloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, connection, sql = local_session(8), connect(sf), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        begin, spent = time.time(), 0.0
        try:
            frame = run(spark, sf)
            spark_rows(frame)
            spent = time.time() - begin
            if name in sql:
                found = difference(frame, connection, sql[name])
                note = "ok" if found is None else f"DIFFERS {found[:600]}"
            else:
                note = f"rows only: {frame.count()}"
        except Exception as error:  # noqa: BLE001
            note = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        bad += note.startswith(("DIFFERS", "FAILED"))
        print(f"{name:32s} {spent:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
