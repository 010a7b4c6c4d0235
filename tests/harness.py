"""Compare a registered query with its SQL twin on the given tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(root: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(root, name + '.parquet')}')")
    return con


def canonical(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("n", "nan" if math.isnan(value) else f"{value:.9g}")
    if isinstance(value, int):
        return ("n", f"{value:.9g}" if abs(value) < 10**9 else str(value))
    return ("x", str(value))


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def spark_table(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    cursor = con.execute(sql)
    return table_of([c[0] for c in cursor.description], cursor.fetchall())


def difference(df, con, sql) -> str | None:
    columns, left = spark_table(df)
    other_columns, right = sql_table(con, sql)
    if columns != other_columns:
        return f"columns {columns} against {other_columns}"
    if left == right:
        return None
    only_left = sorted(set(left) - set(right))[:2]
    only_right = sorted(set(right) - set(left))[:2]
    return f"{len(left)} rows against {len(right)}; spark only {only_left}; sql only {only_right}"
