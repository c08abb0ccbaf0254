"""Every query against its SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from codeloom import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([r[k] for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert got
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, map(tuple, got)) == rows(want.columns, want.fetchall())
