"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], SMALL) is None


def test_entry_runs(spark):
    assert entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
