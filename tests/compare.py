"""Runs a query's SQL in DuckDB and compares the rows, columns sorted by name and rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names)))), names


def same(df, con, sql):
    got, names = rows(df.toArrow())
    want, others = rows(con.sql(sql).to_arrow_table())
    assert names == others
    assert len(got) == len(want)
    assert got == want
