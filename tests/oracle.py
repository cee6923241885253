"""Holds a query's rows against its SQL in DuckDB, sorted, as text."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def expected(sql: str, sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def text(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):  # integers with nulls among them come as floats
        return str(int(v)) if v.is_integer() else repr(float(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


def same(spark_df, sql: str, sf_dir: str = DATA) -> None:
    got, want = rows(spark_df.toPandas()), rows(expected(sql, sf_dir))
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    differing = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not differing, differing[:3]
