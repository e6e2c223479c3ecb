"""Spark's rows against DuckDB's, as multisets."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def same(df, sql, sf):
    cursor = duck(sf).execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr)
    assert len(got) == len(expected)
    assert got == expected
