"""Tables by month and status, replaced month by month, with maintained totals."""

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_listing import operators
from tillscope.catalog import OPERATORS, run
from tillscope.functions.measures import Sales
from tillscope.operators.customers import e1_top_customers_preagg
from tillscope.operators.trends import c1_monthly_trend, d2_month_over_month, e2_monthly_gross
from tillscope.plans.frames import sold_lines
from tillscope.sources.monthly import MonthlyTables, replace_months, write_months
from tillscope.sources.star_schema import AS_OF

MONTH = date(2023, 3, 1)


@pytest.fixture(scope="module")
def stored(spark, standard, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("months"))
    write_months(standard, root)
    return root


def scans(frame):
    """(table, folders read) of every scan that ran."""
    frame.collect()
    found = operators(frame._jdf.queryExecution().executedPlan())
    return {
        scan.relation().location().rootPaths().head().getName(): scan.metrics().apply("numPartitions").value()
        for scan in found
        if scan.nodeName().startswith("Scan parquet") and scan.metrics().contains("numPartitions")
    }


@pytest.mark.parametrize("name", ["a1_order_details", "a3_segment_revenue", "b1_above_average_customers",
    "c1_monthly_trend", "c3_customer_lifetime_value", "d1_top_products_by_region", "d2_month_over_month",
    "e1_top_customers_preagg", "e2_monthly_gross", "f1_product_margin", "g7_row_counts", "q_fk", "q_nn"])
def test_reports_are_those_of_the_source(spark, standard, stored, name):
    parameters = {"as_of": AS_OF}
    expected, found = (run(m, name, **parameters) for m in (standard, MonthlyTables(spark, stored)))
    assert name in OPERATORS and found.columns == expected.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_one_month_is_one_folder(spark, standard, stored):
    model = MonthlyTables(spark, stored, months=[MONTH])
    months = e2_monthly_gross(model)
    assert scans(months) == {"month_sums": 1}
    expected = e2_monthly_gross(standard).where(F.col("sales_month") == MONTH)
    assert months.collect() == expected.collect()
    # Lines are pruned by status and month as their orders are.
    lines = sold_lines(model, Sales.DELIVERED, "order_date").groupBy("product_id").agg(F.sum("net_micros"))
    assert scans(lines) == {"orders": 1, "order_items": 1}
    whole = MonthlyTables(spark, stored)
    recent = whole.kept_orders(Sales.DELIVERED, F.lit(date(2023, 11, 5))).groupBy().count()
    assert scans(recent)["orders"] <= 2


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def content(spark, root):
    model = MonthlyTables(spark, root)
    frames = {"orders": model._read("orders"), "order_items": model._read("order_items"),
              "order_totals": model.keyed_totals, "month_sums": model.month_sums}
    return {name: sorted(map(str, frame.collect())) for name, frame in frames.items()}


def test_replaced_months_equal_a_rebuild(spark, standard, tmp_path_factory):
    """Changed, late and removed lines, an order with a new state, a state that no order has any more."""
    kept, rebuilt = (str(tmp_path_factory.mktemp(name)) for name in ("kept", "rebuilt"))
    write_months(standard, kept)
    before = files(kept)
    in_month = F.trunc("order_date", "MM") == F.lit(MONTH)
    ids = [r.order_id for r in standard.orders.where(in_month).orderBy("order_id").limit(3).collect()]
    status = F.when(in_month & (F.col("status") == "Pending"), "Shipped").otherwise(F.col("status"))
    lines = standard.order_items.where(F.col("order_id") != ids[0])
    more = F.when(F.col("order_id") == ids[1], F.col("quantity") + 5).otherwise(F.col("quantity"))
    lines = lines.withColumn("quantity", more.cast("int"))
    late = lines.where(F.col("order_id") == ids[2]).withColumn("order_item_id", -F.col("order_item_id"))
    changed = standard.with_tables(
        orders=standard.orders.withColumn("status", status), order_items=lines.unionByName(late)
    )
    for _ in range(2):  # a retry changes nothing
        replace_months(changed, kept, [MONTH])
    write_months(changed, rebuilt)
    assert content(spark, kept) == content(spark, rebuilt)
    name = f"order_month={MONTH}"
    after = files(kept)
    assert {p: t for p, t in before.items() if name not in p} == {p: t for p, t in after.items() if name not in p}
    assert not any(name in p for p in before.keys() & after.keys())
    model = MonthlyTables(spark, kept)
    for report in (c1_monthly_trend, d2_month_over_month, e2_monthly_gross, e1_top_customers_preagg):
        assert report(model).collect() == report(changed).collect()


def test_lines_without_an_order_are_kept(spark, hand, tmp_path):
    lines = hand.order_items.withColumn(
        "order_id", F.when(F.col("order_item_id") == 1, 999).otherwise(F.col("order_id")).cast("bigint")
    )
    write_months(hand.with_tables(order_items=lines), str(tmp_path))
    model = MonthlyTables(spark, str(tmp_path))
    assert model.order_items.count() == lines.count()
    assert (Path(tmp_path) / "order_items/order_month=unknown").exists()
    assert model.keyed_totals.where("order_id = 999").count() == 0
