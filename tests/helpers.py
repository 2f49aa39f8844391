"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf: str, name: str, queries, oracle) -> None:
    df = queries[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf).execute(oracle[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == rows(cols, cur.fetchall())
