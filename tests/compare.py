"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares all rows."""

import os

import duckdb


def duck(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows_of(frame):
    def text(x):
        if x is None or (isinstance(x, float) and x != x):
            return "NULL"
        return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(text(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


def assert_same(spark, folder, query, sql):
    got, want = query(spark, folder).toPandas(), duck(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
