import pytest

from fathomline.plans import load_core

SMALL = "/root/testdata/sf0.001"
CORE = load_core()


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(CORE.queries))
def test_runs_without_nested_loops(spark, name):
    df = CORE.queries[name](spark, SMALL)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize(("name", "unread"), [("metric_cards", "statement"), ("title_slugs", "num_comments"), ("crowded_sources", "statement"), ("supplier_corroboration", "l_tax")])
def test_scans_read_only_what_is_used(spark, name, unread):
    schemas = [x for x in _plan(CORE.queries[name](spark, SMALL)).split("ReadSchema: ")[1:]]
    assert schemas and all(unread not in s.splitlines()[0] for s in schemas)


def test_filters_reach_the_scan(spark):
    plan = _plan(CORE.queries["daily_points"](spark, SMALL))
    assert "EqualTo(event_type,purchase)" in plan.split("PushedFilters: ")[1].splitlines()[0]


def test_every_sql_has_its_query():
    assert set(CORE.sql) <= set(CORE.queries)
