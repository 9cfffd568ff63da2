"""Every query with SQL agrees with DuckDB; the others run."""

import os

import parity
import pytest

from weftline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, folder, name):
    assert parity.difference(spark, duck, QUERIES[name], SQL[name], folder) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() >= 0


def test_names_are_of_queries():
    assert set(SQL) <= set(QUERIES)
