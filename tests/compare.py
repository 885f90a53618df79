"""Run a query on Spark and its SQL on DuckDB, and compare rows whatever their order."""

from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    return float(f"{value:.12g}") if isinstance(value, float) else value


def sort_key(row):
    return tuple((x is not None, str(x)) for x in row)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=sort_key)


def assert_same(df, con, sql):
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, answer.fetchall())
