"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = Path("/root/testdata/sf0.001")

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_counterpart_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    frame = contract.queries()[name](spark, str(SF_DIR))
    answer = sql.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, answer.fetchall()))


def test_entry(spark):
    assert contract.entry(spark).count() > 0
