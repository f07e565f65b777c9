"""Relations between reports that hold on any data."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillscope.functions.measures import Sales
from tillscope.operators.customers import c3_customer_lifetime_value, d4_spend_quartiles
from tillscope.operators.dashboard import vc1_running_total, vd2_growth_direction, vst_stat_strip
from tillscope.operators.insights import (
    i2_region_year,
    i3_segment_profile,
    i5_quarter_growth,
    i6_peak_trough_month,
    i8_segment_uplift,
)
from tillscope.operators.joins import a1_order_details, a3_segment_revenue
from tillscope.operators.products import f1_product_margin
from tillscope.operators.subqueries import b2_category_revenue_share
from tillscope.operators.trends import (
    c1_monthly_trend,
    d2_month_over_month,
    d3_region_running_total,
    e2_monthly_gross,
    e2_monthly_gross_preproject,
)
from tillscope.plans.frames import customer_sales
from tillscope.sources.star_schema import AS_OF, StarSchema


@pytest.fixture(scope="module", params=["given", "generated"])
def model(request, spark, standard):
    return standard if request.param == "generated" else StarSchema(spark, "/root/testdata/sf0.001")


def total(frame, column):
    return frame.agg(F.sum(column)).first()[0]


def test_revenue_is_the_same_by_segment_month_and_category(model):
    exact = total(customer_sales(model, Sales.VALID), "net")
    for frame, column in (
        (a3_segment_revenue(model), "total_net_revenue"),
        (c1_monthly_trend(model), "net_revenue"),
        (b2_category_revenue_share(model), "total_net_revenue"),
        (d3_region_running_total(model), "net_revenue"),
    ):
        assert abs(total(frame, column) - exact) <= D("0.005") * frame.count()


def test_shares_add_up(model):
    for frame, column in (
        (b2_category_revenue_share(model), "revenue_pct"),
        (i3_segment_profile(model), "revenue_pct"),
        (i3_segment_profile(model), "pct_of_base"),
    ):
        assert abs(total(frame, column) - 100) <= D("0.05") * frame.count()
    for row in i2_region_year(model).groupBy("sales_year").agg(F.sum("pct_of_year")).collect():
        assert abs(row[1] - 100) <= D("0.5")


def test_running_totals_end_at_the_total(model):
    months = vc1_running_total(model).collect()
    exact = total(customer_sales(model, Sales.VALID), "net")
    assert abs(months[-1].running_total - exact) <= D("0.005")
    for region in {r.region_name for r in d3_region_running_total(model).collect()}:
        rows = d3_region_running_total(model).filter(F.col("region_name") == region).collect()
        assert rows[-1].running_total == sum(r.net_revenue for r in rows)


def test_detail_adds_up_to_the_monthly_gross_of_its_status(model):
    delivered = a1_order_details(model).filter("status = 'Delivered'")
    assert total(delivered, "gross_revenue") == total(e2_monthly_gross(model), "gross_revenue")
    slow = [tuple(r) for r in e2_monthly_gross(model).collect()]
    assert [tuple(r) for r in e2_monthly_gross_preproject(model).collect()] == slow


def test_quartiles_are_even_and_ordered(model):
    rows = (
        d4_spend_quartiles(model)
        .groupBy("spend_quartile")
        .agg(F.count("*"), F.min("total_spend"), F.max("total_spend"))
        .orderBy("spend_quartile")
        .collect()
    )
    sizes = [r[1] for r in rows]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert all(a[3] <= b[2] for a, b in zip(rows, rows[1:]))


def test_value_report_lists_every_spender_once(model):
    report = c3_customer_lifetime_value(model, AS_OF)
    assert report.count() == customer_sales(model, Sales.VALID).count()
    assert report.select("customer_id").distinct().count() == report.count()
    assert report.filter("(orders_per_year IS NULL) != (clv_3yr_estimate IS NULL)").count() == 0


def test_ranks_start_at_one_and_every_product_is_listed(model):
    report = f1_product_margin(model)
    assert report.count() == model.products.count()
    assert report.agg(F.min("profit_rank")).first()[0] == 1


def test_each_month_is_its_neighbours_neighbour(model):
    rows = d2_month_over_month(model).collect()
    for before, after in zip(rows, rows[1:]):
        assert before.next_month_revenue == after.net_revenue
        assert after.prev_month_revenue == before.net_revenue
    arrows = vd2_growth_direction(model).collect()
    assert arrows[0].direction is None
    assert all((r.mom_growth_pct > 0) == (r.direction == "▲") for r in arrows[1:])


def test_extremes_and_quarters(model):
    months = c1_monthly_trend(model).count()
    assert total(i5_quarter_growth(model), "months") == months - 1
    for year in i6_peak_trough_month(model).groupBy("sales_year").agg(
        F.max("is_peak"), F.max("is_trough")
    ).collect():
        assert year[1] and year[2]


def test_stat_strip_and_uplift(model):
    strip = vst_stat_strip(model).first()
    assert strip.tables == 6
    assert strip.total_rows == sum(
        model.table(t).count()
        for t in ("regions", "categories", "customers", "products", "orders", "order_items")
    )
    first, second = [r.segment for r in a3_segment_revenue(model).collect()][:2]
    there = i8_segment_uplift(model, first, second).first()
    assert there.source_revenue_per_customer is not None
    gap = there.target_revenue_per_customer - there.source_revenue_per_customer
    exact = gap * there.source_customers / 10
    assert abs(there.revenue_uplift - exact) <= D("0.005")
