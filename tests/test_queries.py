import os

import pytest

import __spark_entry__  # noqa: F401
from leafmill.queries import catalog
from tests.compare import difference, views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return views(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert difference(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], DATA) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
