"""Holds a Spark query against DuckDB SQL on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same(spark_df, sql, sf_dir):
    got, want = spark_df.toPandas(), connect(sf_dir).execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert len(got) == len(want)
    rows = lambda df: sorted([tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in df[cols].itertuples(index=False)], key=repr)
    a, b = rows(got), rows(want)
    for x, y in zip(sorted(a, key=str), sorted(b, key=str)):
        assert x == y
