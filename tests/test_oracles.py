"""Every core query that SQL can express gives the rows of its SQL."""

from __future__ import annotations

import pytest
from conftest import DATA, same

from cellwright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert same(got, duck.sql(registry.ORACLES[name]).df()) is None
