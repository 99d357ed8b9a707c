"""Every registered query against its SQL twin, and the shape of its plan."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from runledger.operators import activity as P
from runledger.plans import views as V

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    got = QUERIES[name](spark, small)
    if not got.isStreaming and not name.startswith("T"):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    frame = got.toPandas()
    if name in ORACLES:
        assert compare(frame, con.execute(ORACLES[name]).df()) == []
    else:
        assert len(frame) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_per_key_limits_cut_before_the_shuffle(spark, small):
    plan = P.recent_window(V.state_events(spark, small), 5, ["ts", "seq"], ["run_id"])
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = V.checkpoints(spark, small).where("run_id = 7").select("step")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "o_totalprice" not in plan
