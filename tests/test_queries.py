"""Every query of the reference's own operators against its SQL, on the smallest tables."""

import pytest

from strandflow.plans import registry

from .conftest import oracle, rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    got = registry.QUERIES[name](spark, data)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    assert rows(got.toPandas()) == rows(oracle(registry.ORACLES[name], data))
