"""Registered queries against their oracle, and the shape of their plans."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from tarmaq.bindings import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
ACTIONS = {"claim_all_or_nothing", "scoped_cancellation", "stream_bookings_by_status", "stream_claims",
           "stream_expire_holds", "stream_hold_timers", "stream_sessions", "stream_tumbling_counts"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    query = QUERIES[name]
    if name in ORACLE:
        assert compare(spark, con, query, ORACLE[name], FOLDER) is None
    else:
        assert query(spark, FOLDER).count() > 0


def test_entry(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTIONS))
def test_plan_without_nested_loops_or_python(spark, name):
    """With broadcasts off no plan may fall back to pairing rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython",
                 "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan
