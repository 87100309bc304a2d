"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row: tuple) -> str:
    return repr(tuple(round(x, 6) if isinstance(x, float) else x for x in row))


def differences(spark, con, function, sql: str, sf_dir: str = SF) -> str:
    """'' if columns and rows agree."""
    df = function(spark, sf_dir)
    names = sorted(df.columns)
    want = con.execute(sql)
    theirs = [c[0] for c in want.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    expected = sorted(_key(tuple(r[i] for i in at)) for r in want.fetchall())
    got = sorted(_key(tuple(r)) for r in df.select(*names).collect())
    if got == expected:
        return ""
    a, b = sorted(set(got) - set(expected))[:2], sorted(set(expected) - set(got))[:2]
    return f"{len(got)} and {len(expected)} rows; only Spark {a}; only SQL {b}"
