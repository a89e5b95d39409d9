import pytest
from oracle import spark_rows, sql_rows

from feedlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    assert spark_rows(catalogue.QUERIES[name](spark, data)) == sql_rows(data, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "title", "score", "lab_name", "source_name", "source_type"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_feed_plan_is_a_top_k_with_pruned_scans(spark, data):
    plan = catalogue.feed_trending(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "o_clerk" not in plan
