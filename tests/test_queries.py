"""Every registered query against its check SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield c
    c.close()


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_flagship(spark):
    assert entry.entry(spark).count() == 5
