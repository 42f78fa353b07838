"""Every query against its SQL twin on the smallest tables."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry
from flowsieve.plans import catalog, oracle

SQL = oracle.oracle_sql()
#: Trained by descent: tested against the same steps in one process.
WITHOUT_SQL = {"forecast_recurrent"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    if name in WITHOUT_SQL:
        assert df.count() > 0
    else:
        assert differences(df, con, SQL[name]) is None


def test_every_query_has_a_sql_twin_and_is_registered():
    """The text operators, where they are present, are tested beside them."""
    assert set(catalog.queries()) - WITHOUT_SQL == set(SQL)
    assert set(SQL) <= set(entry.oracle_sql()) and set(catalog.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
