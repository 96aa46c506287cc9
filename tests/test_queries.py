import os

import duckdb
import pytest

from tallyreef.plans import registry
from tests.compare import same
from tests.conftest import TABLES

#: Larger tables than the other tests have: ties and rare rows show there.
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        same(df, tables.sql(registry.ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
