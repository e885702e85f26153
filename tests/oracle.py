"""Comparison of a query with its SQL in DuckDB."""

import collections
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(df, columns):
    return collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def compare(spark, query, sql, folder):
    """Assert that both give the same columns and the same rows."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, found = query(spark, folder), con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows_of(df, columns) == collections.Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())
