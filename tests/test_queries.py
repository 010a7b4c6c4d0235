"""Every registered query against its SQL twin on the given tables."""

import pytest
from harness import connect, difference

from lectern.plans import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(root):
    return connect(root)


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, root, con):
    result = registry.queries()[name](spark, root)
    if name in ORACLES:
        assert difference(result, con, ORACLES[name]) is None
    else:
        assert result.count() > 0
