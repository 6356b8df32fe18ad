"""Every registered query against its SQL on the smallest sample."""

import pytest

from tests.harness import compare, oracle_connection
from veritrace.plans.all_queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES, ORACLES, SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
