"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{data}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(value):
    if value is None or value != value:
        return None
    return format(float(value), ".9g") if isinstance(value, float) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


def check(frame, sql: str, data: str) -> None:
    result = connect(data).execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(names, result.fetchall())
