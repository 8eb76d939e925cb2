"""The subpackage's queries beside their SQL; those without SQL give rows."""

import pytest

from seqloom.llm.entries import ORACLE, QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    ok, text = compare(spark, data, name, QUERIES[name], ORACLE.get(name), con)
    assert ok, text
