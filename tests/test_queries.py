"""Every core query with a SQL twin gives the twin's rows."""

import pytest

from tests.oracle import assert_same
from tidewater.plans import registry

SQL = registry.oracle_sql()


def test_every_query_has_a_twin_or_is_known_to_have_none():
    assert set(registry.queries()) - set(SQL) == {"p1_grid", "p5_flags"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, sf, name):
    assert_same(spark, sf, registry.queries()[name], SQL[name])
