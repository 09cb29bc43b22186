"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return round(v, 3) + 0.0 if isinstance(v, float) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def assert_same(df, con, sql):
    """Same columns and rows; returns how many rows."""
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(columns, got.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs), mine[:2], theirs[:2])
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, f"{a} != {b}"
    return len(mine)
