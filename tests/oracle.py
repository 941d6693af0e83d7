"""Comparison of a query with its SQL: rows as sorted tuples of text, doubles rounded."""

import math
import os


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, list):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def assert_same(spark, build, sql, folder):
    df = build(spark, folder)
    ours, cols = df.collect(), sorted(df.columns)
    found = connect(folder).execute(sql)
    names = [x[0] for x in found.description]
    theirs = found.fetchall()
    assert cols == sorted(names)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in ours)
    b = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in theirs)
    assert a == b
