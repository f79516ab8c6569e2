"""Compare a query's rows with those of its SQL, whatever their order."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return None if x is None else str(x)


def assert_same(df, db, sql):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = db.execute(sql)
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    want = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
