"""Every registered query against its SQL on the smallest tables."""

import pytest

from hexlode.plans import catalog
from tests.duck import SMALL, rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = rows(catalog.QUERIES[name](spark, SMALL).toPandas())
    if name in catalog.SQL:
        assert got == sql_rows(catalog.SQL[name], SMALL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
