"""Every registered query with SQL gives the same rows in both engines; the others run."""

import pytest

from synchrony.plans import registry

from .oracle import assert_same

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
