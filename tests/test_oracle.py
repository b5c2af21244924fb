"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import pytest

import oracle_check
from corpuslane.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    message, good = oracle_check.compare(spark, con, SF, name, catalog.queries()[name], catalog.oracle_sql().get(name))
    assert good, message
