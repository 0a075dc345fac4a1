"""Every registered query of the core against its SQL, or at least run, on the smallest tables."""

import pytest

from compare import differences
from quantloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert differences(df, catalog.ORACLES[name], SF) == ""
    else:
        assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert catalog.ORACLES.keys() <= catalog.QUERIES.keys()
