"""Compares a query's rows with those of DuckDB for its SQL."""

import glob
import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 6)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(spark, run, sql, folder, connection=None):
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    c = (connection or connect(folder)).execute(sql)
    want = rows_of([x[0] for x in c.description], c.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]), got[1][:3], want[1][:3])
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (a, b)
    return len(got[1])
