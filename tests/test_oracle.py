"""Each query of the library against its SQL, on the smallest tables."""

import pytest

from palimpsest.plans import core

from .conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(core.QUERIES[name](spark, SMALL), duck.sql(core.ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["id", "score"] and df.count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
