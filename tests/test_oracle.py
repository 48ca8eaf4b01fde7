"""Every query with SQL against DuckDB over the smallest tables, and every other one for a stable schema."""

import pytest
from oracle import compare, connect
from quarry.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, registry.queries()[name], SQL.get(name)) == ""


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "doc_id", "score", "rank"] and rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
