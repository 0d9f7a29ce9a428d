"""Every registered query against its DuckDB check, at the smallest scale."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        stem = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {stem} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, name):
    frame = queries()[name](spark, SF_DIR)
    mine = canonical(frame.columns, frame.collect())
    if name in oracle_sql():
        result = db.execute(oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert mine == canonical(names, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
