import pytest
from compare import check
from conftest import SF

from chronoscope.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plans_avoid_nested_loops(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filter_reaches_the_scan(spark):
    plan = catalogue.QUERIES["q_stream_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "props" not in plan.split("ReadSchema")[1]
