"""Comparison of a DataFrame with the SQL that DuckDB runs on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 8))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def assert_same(df, relation):
    names = sorted(df.columns)
    assert sorted(relation.columns) == names
    places = [relation.columns.index(c) for c in names]
    got = sorted(tuple(plain(row[c]) for c in names) for row in df.collect())
    want = sorted(tuple(plain(row[i]) for i in places) for row in relation.fetchall())
    assert got == want
