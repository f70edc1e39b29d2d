"""Run a query's SQL in DuckDB over the same tables and compare whole results."""

import math
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
    found = con.execute(sql)
    assert sorted(c[0] for c in found.description) == names
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple((x is None, x if not isinstance(x, float) else round(x, 9)) for x in r)
    got, want = sorted(got, key=key), sorted(map(tuple, want), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12) for x, y in zip(g, w, strict=True)), (g, w)
