"""Compare registered queries with their DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, bytearray):
        return bytes(x)
    return x


def compare(spark, con, sf_dir, query, sql):
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names), (got.columns, names)
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    at = [names.index(c) for c in order]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (order, x, y)
    return len(a)
