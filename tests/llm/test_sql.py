"""Every corpus query that has SQL against it, on the same tables."""

import pytest
from compare import connect, difference

from longspark.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
