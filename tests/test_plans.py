"""Plan checks: filters reach the Parquet scan, scans read only the columns
used, and no pairwise product appears in the join-heavy queries."""

from cadenza.plans import registry
from cadenza.plans.inputs import playlist_adds

from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(plan):
    return [line for line in plan.split("\n") if "FileScan" in line]


def test_filter_pushed_and_columns_pruned(spark):
    scans = _scans(_plan(playlist_adds(spark, SF001)))
    events = next(s for s in scans if "events.parquet" in s)
    assert "PushedFilters: [In(event_type, [click,view])]" in events
    assert "value:" not in events  # the unused column is not read
    part = next(s for s in scans if "part.parquet" in s)
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in part


def test_no_pairwise_products(spark):
    registry.load_all()
    for name in ["fuzzy_join", "fuzzy_search", "recommend", "replay_requests", "feature_wide",
                 "playlist_state", "register_unique_name", "login_lookup"]:
        plan = _plan(registry.QUERIES[name](spark, SF001))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
