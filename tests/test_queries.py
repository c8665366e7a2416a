"""Every query that has SQL gives what DuckDB gives; every other one runs."""

import pytest
from tables import DATA

from pricelode.plans import catalogue

catalogue.load()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(compare, name):
    compare(catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
