"""Holds a query's rows against DuckDB's over the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df: pd.DataFrame):
    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    df = df.where(df.notna(), None)

    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


def same(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
