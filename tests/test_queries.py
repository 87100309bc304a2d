import pytest

from tests.oracle import SF, connect, differences
from tidemark.plans import registry


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF) == ""
