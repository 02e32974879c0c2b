"""Every query with SQL against DuckDB, on the small tables."""

import pytest

from ridgeline.plans import registry
from tests.duck import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, name):
    same(registry.QUERIES[name](spark, SF), SF, registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
