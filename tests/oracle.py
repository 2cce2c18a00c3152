"""Rows of a query and of its SQL, in a form that compares."""

import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        g = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{g}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in data)


def assert_same(df, con, sql):
    got = df.collect()
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda rs: sorted(rs, key=repr)
    order = sorted(names)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    a = key([tuple(norm(r[c]) for c in order) for r in got])
    b = key([tuple(norm(r[names.index(c)]) for c in order) for r in want.fetchall()])
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
