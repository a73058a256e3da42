"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from factloom import queries


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{file}')")
    return con


def rows(frame):
    plain = lambda v: "None" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, tables, name):
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    expected = tables.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["s", "p", "o", "o_kind", "datatype"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
