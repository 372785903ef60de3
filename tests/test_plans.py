"""Shape of the physical plans: no nested loops, limits before shuffles, filters in the scan."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandline.operators import joins, windows
from strandline.operators.ordered import numbered
from strandline.plans import templates
from strandline.plans.registry import load_all
from strandline.session import block_of

# these run jobs while they are built; the operators inside are covered by the others
EAGER = ("T0", "T1", "T2", "S0", "S13", "K0", "W13", "W14", "P24")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in load_all() if not n.startswith(EAGER)]


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loop(name, tables):
    plan = plan_of(load_all()[name].run(tables))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_latest_row_is_limited_before_the_shuffle(tables):
    jobs = tables.jobs.select("parent_id", "id", "started_s")
    plan = plan_of(windows.latest_per_key(jobs, ["parent_id"], ["started_s", "id"]))
    limit, exchange = plan.rindex("WindowGroupLimit"), plan.index("Exchange")
    assert "Partial" in plan and limit > exchange  # the partial limit is below the exchange


def test_running_values_shuffle_rows_once(spark, tables):
    rows = tables.events.select("user_id", "event_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(numbered(rows, ["user_id"], ["event_id"], block_of(F.col("event_id")), "n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows by (key, block); summaries by (key, block), by key, and back to (key, block)
    assert plan.count("Exchange hashpartitioning(user_id") <= 4
    assert "Exchange SinglePartition" not in plan


def test_year_filter_and_columns_reach_the_scan(tables):
    plan = plan_of(templates.orders_by_status(tables.orders, 1998))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderkey" not in plan


def test_top_k_is_not_a_full_sort(tables):
    assert "TakeOrderedAndProject" in plan_of(templates.top_customers(tables.customer, 0.0, 20))


def test_orders_are_summed_before_the_join(tables):
    plan = plan_of(templates.top_spenders(tables.customer, tables.orders))
    assert "partial_sum(o_totalprice" in plan
    assert plan.index("Join") < plan.index("partial_sum(o_totalprice")


def test_overlaps_do_not_join_a_topic_with_itself(tables):
    jobs = tables.topic_jobs.withColumn("topics", F.split("topics", ","))
    plan = plan_of(joins.find_overlaps(jobs))
    assert "WindowGroupLimit" in plan


def test_daily_users_push_the_date_range(tables):
    plan = plan_of(templates.daily_users(tables.events, datetime.date(2024, 1, 31)))
    assert "GreaterThanOrEqual(ts," in plan
