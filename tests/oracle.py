"""Spark results against DuckDB on the same tables."""

import os
from pathlib import Path

import duckdb


def connection(directory):
    con = duckdb.connect()
    for p in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else os.path.join(p, '*.parquet')}')")
    return con


def shown(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.8g}"
    return str(value)


def difference(df, con, sql):
    """(rows only Spark has, rows only DuckDB has), as multisets of text."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    at = [names.index(c) for c in columns]
    mine = sorted("|".join(map(shown, r)) for r in got)
    theirs = sorted("|".join(shown(r[i]) for i in at) for r in want)
    if mine == theirs:
        return [], []
    return sorted(set(mine) - set(theirs))[:5] or ["multiplicity"], sorted(set(theirs) - set(mine))[:5]
