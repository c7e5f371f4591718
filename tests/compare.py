"""Compares a query with its SQL on the same Parquet tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(_cell, value)) + "]"
    return str(value)


def assert_same(spark, sf_dir, query, sql):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted("|".join(_cell(r[c]) for c in columns) for r in frame.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted("|".join(_cell(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert mine == theirs
