"""Every query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import oracles, queries
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = queries.queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    result = entry.entry(spark)
    assert {"t_inter", "diff_temperature"} <= set(result.columns)
    assert result.count() > 0
