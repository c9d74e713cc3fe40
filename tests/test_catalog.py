"""Every query with SQL, against that SQL."""

import pytest

from gridloom.plans.catalog import FLAGSHIP, ORACLES, QUERIES

from .compare import both, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    ours, theirs = both(spark, con, QUERIES[name], ORACLES[name])
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", ["phase_shift", "block_shifts", "block_median", "block_warp", "mosaic_registered"])
def test_registration_of_a_larger_image(spark, name):
    folder = "/root/testdata/sf0.01"
    ours, theirs = both(spark, connect(folder), QUERIES[name], ORACLES[name], folder)
    assert ours == theirs and ours


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
