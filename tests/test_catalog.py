"""Each query of the catalogue against the same in SQL."""

import os

import pytest

from tagweave import catalog
from tests.compare import connect, differs

DATA = os.environ.get("TAGWEAVE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_as_sql(spark, con, name):
    assert not differs(spark, con, catalog.QUERIES[name], catalog.SQL[name], DATA)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
