"""The easily lost details of each analysis, on rows small enough to check by hand."""

from datetime import date
from decimal import Decimal as D

import pytest
from hand_model import HAND, build_model

from tillscope.functions.measures import Sales, money, ratio, yearly_rate
from tillscope.operators.customers import (
    Tiers,
    c3_customer_lifetime_value,
    d4_spend_quartiles,
    e1_top_customers_correlated,
    e1_top_customers_preagg,
    f2_cohort_retention,
    vc3_clv_ntile,
)
from tillscope.operators.dashboard import va3_segment_revenue_all, ve1_top_customers_nulls_first
from tillscope.operators.hierarchy import c2_category_tree
from tillscope.operators.insights import i7_leaf_underperformers
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
from tillscope.operators.trends import (
    c1_monthly_trend,
    d2_month_over_month,
    d3_region_running_total,
    e2_monthly_gross,
    e2_monthly_gross_preproject,
)

AS_OF = date(2023, 7, 1)


def rows(frame, *columns):
    return [tuple(row) for row in (frame.select(*columns) if columns else frame).collect()]


def test_detail_joins_leaf_category_and_orders_newest_first(hand):
    detail = rows(
        a1_order_details(hand, ordered=True),
        "order_id", "customer_name", "category_name", "gross_revenue", "net_revenue",
    )
    assert detail == [
        (6, "Cy Poe", "Puzzles", D("10.05"), D("5.03")),  # 5.025 rounds away from zero
        (4, "Bob Ray", "Drills", D("180.00"), D("162.00")),
        (2, "Ann Lee", "Drills", D("100.00"), D("100.00")),
        (1, "Ann Lee", "Drills", D("100.00"), D("100.00")),
        (1, "Ann Lee", "Puzzles", D("20.00"), D("20.00")),
        (5, "Bob Ray", "Puzzles", D("30.00"), D("26.25")),
    ]


def test_any_order_even_cancelled_makes_a_customer(hand):
    found = rows(a2_customers_without_orders(hand, AS_OF), "customer_id", "days_since_joined")
    assert found == [(5, (AS_OF - date(2017, 1, 1)).days)]


def test_dormant_customers_can_be_narrowed(hand):
    dormant = a2_customers_without_orders(
        hand, AS_OF, since=date(2023, 5, 1), sales=Sales.VALID, ordered=True
    )
    assert [r[0] for r in rows(dormant, "customer_id")] == [5, 4, 1]


def test_segments_count_orders_with_lines_only(hand):
    assert rows(a3_segment_revenue(hand)) == [
        ("Gold", 2, 4, D("408.25"), D("81.65"), D("102.06")),
        ("Bronze", 1, 1, D("5.03"), D("5.03"), D("5.03")),
    ]


def test_dashboard_segments_take_every_status(hand):
    assert rows(va3_segment_revenue_all(hand)) == [
        ("Gold", 2, 5, D("608.25"), D("121.65")),
        ("Bronze", 2, 2, D("205.03"), D("102.51")),
    ]


def test_average_spend_is_per_buying_customer_and_unrounded(hand):
    # spends 220, 188.25 and 5.025: mean 137.758
    above = rows(b1_above_average_customers(hand, ordered=True), "customer_id", "lifetime_spend")
    assert above == [(1, D("220.00")), (2, D("188.25"))]


def test_average_excludes_equal_spend(spark):
    items = [(1, 1, 1, 1, "10.00", "0.00"), (2, 4, 1, 1, "10.00", "0.00")]
    model = build_model(spark, order_items=items)
    assert b1_above_average_customers(model).count() == 0


def test_root_share_climbs_one_level(hand):
    # nothing valid was sold two levels down, so only two roots show up
    assert rows(b2_category_revenue_share(hand)) == [
        ("Tools", 4, D("362.00"), D("90.50"), D("87.6")),
        ("Toys", 6, D("51.28"), D("8.55"), D("12.4")),
    ]


def test_third_level_belongs_to_its_parent_not_to_the_root(spark):
    orders = [(1, 1, date(2023, 1, 10), None, "Delivered", "Card", "0.00")]
    items = [(1, 1, 2, 1, "200.00", "0.00")]
    model = build_model(spark, orders=orders, order_items=items)
    assert [r[0] for r in rows(b2_category_revenue_share(model))] == ["Drills"]
    assert rows(b3_active_categories(model, AS_OF)) == []


def test_active_categories_need_recent_valid_sales(hand):
    assert rows(b3_active_categories(hand, AS_OF), "category_name") == [("Tools",), ("Toys",)]
    # twelve months back, the first day included
    assert rows(b3_active_categories(hand, date(2024, 4, 30)), "category_name") == [
        ("Tools",),
        ("Toys",),
    ]
    assert rows(b3_active_categories(hand, date(2024, 5, 1)), "category_name") == [("Toys",)]
    assert rows(b3_active_categories(hand, date(2025, 1, 1))) == []


def test_inactive_product_does_not_keep_a_category_active(spark):
    products = [(*p[:6], p[0] != 1) for p in HAND["products"]]
    model = build_model(spark, products=products)
    assert rows(b3_active_categories(model, AS_OF), "category_name") == [("Toys",)]


def test_monthly_trend_accumulates_unrounded_months(hand):
    assert rows(c1_monthly_trend(hand)) == [
        (date(2022, 12, 1), D("26.25"), 1, 1, D("26.25"), D("26.25")),
        (date(2023, 1, 1), D("220.00"), 2, 1, D("110.00"), D("246.25")),
        (date(2023, 4, 1), D("162.00"), 1, 1, D("162.00"), D("408.25")),
        (date(2023, 6, 1), D("5.03"), 1, 1, D("5.03"), D("413.28")),  # 413.275
    ]


def test_month_neighbours_are_rows_and_early_means_are_short(hand):
    assert rows(d2_month_over_month(hand)) == [
        (date(2022, 12, 1), D("26.25"), None, D("220.00"), None, D("26.25")),
        (date(2023, 1, 1), D("220.00"), D("26.25"), D("162.00"), D("738.10"), D("123.13")),
        (date(2023, 4, 1), D("162.00"), D("220.00"), D("5.03"), D("-26.36"), D("136.08")),
        (date(2023, 6, 1), D("5.03"), D("162.00"), None, D("-96.90"), D("129.01")),
    ]


def test_region_total_runs_over_year_ends(hand):
    north = [r for r in rows(d3_region_running_total(hand)) if r[0] == "North"]
    assert [r[3] for r in north] == [D("26.25"), D("246.25"), D("408.25")]
    assert [r[4] for r in north] == [D("6.4"), D("53.9"), D("39.7")]


def test_tree_has_three_levels_and_drops_the_orphan(hand):
    assert rows(c2_category_tree(hand)) == [
        (1, "Tools", 0, "Tools", True),
        (4, "    Drills", 1, "Tools > Drills", True),
        (5, "        Hammer drills", 2, "Tools > Drills > Hammer drills", True),
        (2, "Toys", 0, "Toys", True),
        (6, "    Puzzles", 1, "Toys > Puzzles", True),
        (3, "Books", 0, "Books", False),
    ]


def test_tree_ends_in_spite_of_a_cycle(spark):
    categories = [(1, "A", None, True), (2, "B", 1, True), (1, "A again", 2, True)]
    tree = rows(c2_category_tree(build_model(spark, categories=categories)), "category_id")
    assert tree == [(1,), (2,)]


def test_lifetime_value_rounds_before_multiplying(hand):
    found = {r[0]: r[1:] for r in rows(c3_customer_lifetime_value(hand, AS_OF, ordered=True))}
    # 2 orders in 21 days: 110.00 x 34.76 x 3
    assert found[1][2:8] == (D("220.00"), 2, D("110.00"), D("34.76"), 151, D("11470.80"))
    # the order without lines counts: 188.25 / 3, 3 orders in 125 days
    assert found[2][2:8] == (D("188.25"), 3, D("62.75"), D("8.76"), 57, D("1649.07"))
    # one order: no lifespan, no rate, no estimate; listed first
    assert found[3][2:8] == (D("5.03"), 1, D("5.03"), None, 30, None)
    assert list(found) == [3, 1, 2]


def test_tiers_take_the_first_match(spark):
    cases = [(6000, 90), (6000, 91), (2000, 181), (0, 90), (0, 91), (9999, 365), (9999, 366)]
    frame = spark.createDataFrame(cases, "spend int, days int")
    label = Tiers().label(frame.spend, frame.days)
    assert [r[0] for r in frame.select(label).collect()] == [
        "Champions", "Loyal Customers", "At Risk", "Recent Customers", "At Risk", "At Risk",
        "Lost",
    ]


def test_quartiles_of_three_customers(hand):
    found = rows(d4_spend_quartiles(hand, ordered=True), "customer_id", "spend_tier")
    assert found == [
        (1, "High Spender   (Q3)"),
        (2, "Mid Spender    (Q2)"),
        (3, "Low Spender    (Q1)"),
    ]


def test_dense_rank_keeps_ties(spark):
    orders = [(1, 1, date(2023, 1, 10), None, "Delivered", "Card", "0.00")]
    items = [
        (1, 1, 1, 1, "50.00", "0.00"),
        (2, 1, 2, 1, "50.00", "0.00"),
        (3, 1, 3, 1, "20.00", "0.00"),
        (4, 1, 4, 1, "10.00", "0.00"),
        (5, 1, 5, 1, "5.00", "0.00"),
    ]
    model = build_model(spark, orders=orders, order_items=items)
    assert rows(d1_top_products_by_region(model), "region_rank", "product_name") == [
        (1, "drill"),
        (1, "hammer drill"),
        (2, "jigsaw puzzle"),
        (3, "never sold"),
    ]


def test_top_customers_two_ways(hand):
    slow = rows(e1_top_customers_correlated(hand))
    fast = rows(e1_top_customers_preagg(hand))
    best = [(2, "Bob Ray", D("180")), (1, "Ann Lee", D("120")), (3, "Cy Poe", D("10.05"))]
    assert slow[:3] == fast == best
    assert [r[2] for r in slow[3:]] == [None, None, None]  # customers without spend stay, last
    nulls_first = rows(ve1_top_customers_nulls_first(hand, 4))
    assert nulls_first == [(4, "Di", None), (5, "Ed", None), (6, "Flo", None), (2, "Bob", D("180"))]


def test_delivered_months_two_ways(hand):
    expected = [
        (date(2023, 1, 1), D("120")),
        (date(2023, 4, 1), D("180")),
        (date(2023, 6, 1), D("10.05")),
    ]
    assert rows(e2_monthly_gross(hand)) == expected
    assert rows(e2_monthly_gross_preproject(hand)) == expected


def test_margin_counts_void_lines_and_ranks_unsold_first(hand):
    columns = ("product_id", "margin_pct", "units_sold", "gross_profit", "profit_rank")
    assert rows(f1_product_margin(hand, ordered=True), *columns) == [
        (2, D("75.0"), 2, D("300.00"), 3),  # returned and cancelled lines only
        (1, D("40.0"), 4, D("140.00"), 4),
        (3, D("50.0"), 6, D("30.05"), 5),
        (4, D("66.7"), None, None, 1),
        (5, None, None, None, 1),  # price zero: no margin
    ]
    valid = {r[0]: r for r in rows(f1_product_margin(hand, valid_only=True), *columns)}
    assert valid[2] == (2, D("75.0"), None, None, 1)
    assert valid[1][4] == 4


def test_cohorts_count_line_less_orders_in_whole_months(hand):
    assert rows(f2_cohort_retention(hand)) == [
        (date(2022, 12, 1), 0, 1),
        (date(2022, 12, 1), 4, 1),
        (date(2022, 12, 1), 5, 1),  # the order without lines
        (date(2023, 1, 1), 0, 1),
        (date(2023, 6, 1), 0, 1),
    ]


def test_weak_categories_average_the_rows_that_remain(hand):
    # Tools 362.00, Toys 51.28 (one mean 206.64); only Toys remains
    assert rows(f3_underperforming_categories(hand)) == [
        ("Toys", D("51.28"), 3, D("51.28"), D("0.00"), D("0.0"))
    ]
    assert rows(f3_underperforming_categories(hand, overall_avg=True)) == [
        ("Toys", D("51.28"), 3, D("206.64"), D("-155.36"), D("-75.2"))
    ]


def test_leaves_without_sales_count_as_zero(hand):
    # leaves: Books (a root without children) 0, Hammer drills 0, Puzzles 51.28, Lost 0
    found = rows(i7_leaf_underperformers(hand), "category_name", "net_revenue", "gap_pct")
    assert found == [
        ("Books", D("0.00"), D("-100.0")),
        ("Hammer drills", D("0.00"), D("-100.0")),
        ("Lost", D("0.00"), D("-100.0")),
    ]


def test_dashboard_value_tiers_use_every_status(hand):
    found = rows(vc3_clv_ntile(hand), "customer", "lifetime_value", "orders", "clv_segment")
    assert found == [
        ("Ann Lee", D("420.000000"), 3, "High Value"),
        ("Di Fox", D("200.000000"), 1, "Medium"),
        ("Bob Ray", D("188.250000"), 2, "Low Value"),
        ("Cy Poe", D("5.025000"), 1, "Low Value"),
    ]


@pytest.mark.parametrize(
    ("top", "bottom", "expected"),
    [("10.01", "2", "5.01"), ("-10.01", "2", "-5.01"), ("1", "0", None), ("2", "3", "0.67")],
)
def test_ratio_rounds_half_away_from_zero(spark, top, bottom, expected):
    frame = spark.sql(f"SELECT {top}BD AS a, {bottom}BD AS b")
    value = frame.select(ratio("a", "b")).first()[0]
    assert value == (None if expected is None else D(expected))


def test_money_and_yearly_rate_rounding(spark):
    frame = spark.sql("SELECT 5.125BD AS a, -5.125BD AS b, 2L AS n, 1168 AS days, 0 AS none")
    found = frame.select(
        money("a"), money("b"), yearly_rate("n", "days"), yearly_rate("n", "none")
    ).first()
    assert tuple(found) == (D("5.13"), D("-5.13"), D("0.62"), None)
