"""Compares a query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(directory=DATA):
    con = duckdb.connect()
    for path in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


def same(spark, con, query, sql, directory=DATA):
    df = query(spark, directory)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, result.fetchall())
    assert ours == theirs
