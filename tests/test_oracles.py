"""Every registered query against its SQL on the same tables."""

import os

import pytest
from compare import connect, difference

from longspark.catalog import load

SF = os.environ.get("LONGSPARK_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
