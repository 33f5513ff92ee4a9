"""Every query with SQL against an independent engine, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quire.queries import ORACLE_SQL, QUERIES


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


@pytest.fixture(scope="module")
def other(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, other, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    got = other.sql(ORACLE_SQL[name])
    at = [got.columns.index(c) for c in columns]
    assert len(got.columns) == len(columns)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
