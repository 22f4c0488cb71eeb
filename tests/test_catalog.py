"""Every registered query of the graph engine against its SQL, on the smallest tables."""

import pytest
from helpers import assert_same, duck

from spandrel.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLES:
        assert_same(df, duck(catalog.ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
