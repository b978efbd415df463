"""Every registered query against its DuckDB oracle at sf0.001 (the driver
repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from sitelens.plans import registry
from tests.conftest import SF0001
from tests.oracle import compare, duck

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF0001), ORACLE[name], con)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF0001)
    assert df.count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "overall_score" in df.columns


def test_every_query_has_unique_columns(spark):
    for name, fn in QUERIES.items():
        cols = fn(spark, SF0001).columns
        assert len(cols) == len(set(cols)), name
