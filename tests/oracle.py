"""Compares a query with its SQL in DuckDB."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    columns = sorted(table.columns)
    clean = table[columns].astype(object)
    return columns, sorted(map(str, clean.where(clean.notna(), None).itertuples(index=False, name=None)))


def same(df, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(df.toPandas()) == rows(con.sql(sql).df())
