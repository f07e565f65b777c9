"""Physical plans that must not get worse unnoticed."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tillscope.functions.measures import Sales
from tillscope.operators.customers import (
    c3_customer_lifetime_value,
    d4_spend_quartiles,
    e1_top_customers_correlated,
    e1_top_customers_preagg,
    f2_cohort_retention,
    vc3_clv_ntile,
)
from tillscope.operators.insights import i4_quartile_share
from tillscope.operators.joins import (
    a1_order_details,
    a2_customers_without_orders,
    a3_segment_revenue,
)
from tillscope.operators.products import (
    d1_top_products_by_region,
    f1_product_margin,
    f3_underperforming_categories,
)
from tillscope.operators.subqueries import (
    b1_above_average_customers,
    b2_category_revenue_share,
    b3_active_categories,
)
from tillscope.operators.trends import c1_monthly_trend, e2_monthly_gross
from tillscope.sources.star_schema import AS_OF, StarSchema

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    """Plans as for tables too large to broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield StarSchema(spark, SF_DIR)
    for key in keys:
        spark.conf.unset(key)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame):
    """The adaptive plan after a run."""
    frame.collect()
    return plan(frame).split("== Initial Plan ==")[0]


ANALYSES = {
    "a1": a1_order_details,
    "a2": lambda model: a2_customers_without_orders(model, AS_OF),
    "a3": a3_segment_revenue,
    "b1": b1_above_average_customers,
    "b2": b2_category_revenue_share,
    "b3": lambda model: b3_active_categories(model, AS_OF),
    "c1": c1_monthly_trend,
    "c3": lambda model: c3_customer_lifetime_value(model, AS_OF),
    "d1": d1_top_products_by_region,
    "e1a": e1_top_customers_correlated,
    "e1b": e1_top_customers_preagg,
    "e2": e2_monthly_gross,
    "f1": f1_product_margin,
    "f2": f2_cohort_retention,
    "f3": f3_underperforming_categories,
}


@pytest.mark.parametrize("name", list(ANALYSES))
def test_no_nested_loops_products_or_python(star, name):
    text = plan(ANALYSES[name](star))
    for operator in ("NestedLoop", "CartesianProduct", "Python", "Expand", "ArrowEval"):
        assert operator not in text


@pytest.mark.parametrize("name", list(ANALYSES))
def test_nothing_is_broadcast_without_a_size_check(star, name):
    """With the thresholds off, nothing is; a ranking's cuts and counts are scalar subqueries."""
    assert "BroadcastExchange" not in plan(ANALYSES[name](star))


@pytest.mark.parametrize("report", [i4_quartile_share, vc3_clv_ntile])
def test_quartile_cuts_sort_and_number_no_customers(star, report):
    text = plan(report(star))
    assert "rangepartitioning" not in text and "Window [" not in text.replace("Window [sum", "")
    assert "l_orderkey" not in text and "BroadcastExchange" not in text


def test_ranks_deal_the_rows_once(star):
    frame = f1_product_margin(star)
    text = plan(frame)
    assert "rangepartitioning" not in text and "ExistingRDD" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(_slot#\d+, _dealt", text)) == 1


def test_filters_and_columns_reach_the_scan(star):
    text = plan(e2_monthly_gross(star))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in text
    text = plan(b3_active_categories(star, AS_OF))
    assert "In(o_orderstatus, [F,O])" in text
    assert "GreaterThanOrEqual(o_orderdate,2000-08-02" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_lines_are_folded_before_their_exchange(star):
    text = plan(a3_segment_revenue(star))
    assert re.search(
        r"Exchange hashpartitioning\(order_id#\d+L, \d+\)[^\n]*\n[^\n]*HashAggregate"
        r"\(keys=\[order_id#\d+L\], functions=\[partial_count",
        text,
    )


def test_lines_are_shuffled_once_per_order_join(star):
    text = plan(a3_segment_revenue(star))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", text)) == 2  # lines, orders
    text = plan(d1_top_products_by_region(star))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", text)) == 2


def test_customer_join_reuses_the_grouping_exchange(star):
    text = plan(e1_top_customers_correlated(star))
    # spend is grouped on customer_id; only the customers are exchanged for the join
    assert len(re.findall(r"Exchange hashpartitioning\(customer_id", text)) == 2


def test_dormant_customers_use_an_anti_join_on_distinct_buyers(star):
    text = plan(a2_customers_without_orders(star, AS_OF))
    assert "LeftAnti" in text
    assert text.index("LeftAnti") < text.index("HashAggregate(keys=[customer_id")


def test_category_test_is_an_equi_semi_join(star):
    assert plan(b3_active_categories(star, AS_OF)).count("LeftSemi") >= 2


def test_top_products_are_limited_before_the_region_exchange(star):
    text = plan(d1_top_products_by_region(star))
    assert "dense_rank(net_revenue" in text
    assert text.index(", 3, Final") < text.index(", 3, Partial")


def test_top_customers_are_a_bounded_heap(star):
    assert "TakeOrderedAndProject" in plan(e1_top_customers_correlated(star))
    assert "TakeOrderedAndProject" in plan(e1_top_customers_preagg(star))


def test_mean_spend_and_its_comparison_read_the_written_totals(star):
    text = final_plan(b1_above_average_customers(star))
    assert "l_orderkey" not in text and "o_orderkey" not in text


def test_quartiles_need_no_single_task(star):
    text = plan(d4_spend_quartiles(star))
    # the only single-task windows run over one row per partition
    for window in re.findall(r"Window \[[^\n]*", text):
        assert "_rows" in window


def test_cohorts_fold_orders_before_they_are_exchanged(star):
    text = plan(f2_cohort_retention(star))
    first = text.rindex("Exchange hashpartitioning(customer_id")
    assert "HashAggregate(keys=[customer_id" in text[first:]


def test_date_arguments_are_the_only_clock(star):
    one = a2_customers_without_orders(star, date(2020, 1, 1))
    assert "current_date" not in plan(one)
    assert "current_date" not in plan(star.kept_orders(Sales.VALID, F.lit(date(2020, 1, 1))))
