"""Every registered query equals its SQL on the smallest tables, and joins no pairs."""

import os

import pytest
from tests.helpers import plan_of

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, views
from checks.oracle import ORACLE
from checks.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

# Model-based or approximate: rows only.
WITHOUT_SQL = {"semantic_topk_approx", "semantic_search_documents"}


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in WITHOUT_SQL:
        assert name not in oracle_sql() and df.count() > 0
        return
    good, note = compare(df, con, oracle_sql()[name])
    assert good, note


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) | WITHOUT_SQL == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())
