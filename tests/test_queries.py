"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from signalpact.plans.oracle import ORACLE
from signalpact.plans.queries import QUERIES
from tests.oracle_check import compare

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry.queries())
    assert ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF_DIR, name, entry.queries()[name], ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 5
