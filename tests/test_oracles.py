"""Every registered core query against its DuckDB SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not there")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(repr, r)) for r in frame.where(frame.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = tables.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
