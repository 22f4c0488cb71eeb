"""Comparison with DuckDB."""

import os

DATA = "/root/testdata/sf0.001"


def duck(sql: str, folder: str = DATA):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return c.sql(sql)


def assert_same(df, relation) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    theirs = sorted(tuple(map(str, r)) for r in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert ours == theirs
