"""Run a query with Spark and its SQL twin with DuckDB, and compare rows, names and types."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = rows_of(names, result.fetchall())
    problems = []
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} / {sorted(names)}"]
    for field in spark_df.schema.fields:
        want = SPARK_TO_DUCK.get(field.dataType.simpleString(), field.dataType.simpleString())
        if want != types[field.name]:
            problems.append(f"type of {field.name}: {want} / {types[field.name]}")
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} / {len(expected)}")
    if got != expected:
        a, b = set(got), set(expected)
        problems.append(f"only here: {sorted(a - b)[:3]}")
        problems.append(f"only expected: {sorted(b - a)[:3]}")
    return problems
