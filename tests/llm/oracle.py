"""Run a query's SQL in DuckDB over the same tables and compare whole results."""

import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def assert_same(df, sql, sf_dir):
    names = sorted(df.columns)
    con = tables(sf_dir)
    rel = con.execute(sql)
    assert sorted(c[0] for c in rel.description) == names
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(map(tuple, want), key=key)
