"""Every query with SQL gives the SQL's rows; the others give rows."""

import pytest

from tests.conftest import SMALL, same_rows
from tidewell.plans import queries as registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SMALL), duck, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
