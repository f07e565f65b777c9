"""A third of all rows on one key: same results, and the key's work is split or folded."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tillscope.functions.measures import Sales, month_of
from tillscope.model import RetailModel
from tillscope.operators.customers import d4_spend_quartiles, f2_cohort_retention
from tillscope.operators.joins import a1_order_details, a3_segment_revenue
from tillscope.operators.products import d1_top_products_by_region, f1_product_margin
from tillscope.operators.quality import q_fk
from tillscope.operators.trends import c1_monthly_trend, e2_monthly_gross
from tillscope.sources.generate import gen_model

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all lines belong to order 4 and to product 1; customer 5 has a third of orders."""
    base = gen_model(spark, customers=300, orders=3000)
    hot_customer = F.when(F.col("order_id") % 3 == 0, 5).otherwise(F.col("customer_id"))
    more = spark.range(1, 8001).select(
        (F.col("id") + 1_000_000).alias("order_item_id"),
        F.lit(4).cast("bigint").alias("order_id"),
        F.lit(1).cast("bigint").alias("product_id"),
        (F.col("id") % 5 + 1).cast("int").alias("quantity"),
        ((F.col("id") * 7919 % 9000 + 1000) / 100).cast("decimal(10,2)").alias("unit_price"),
        F.lit("2.50").cast("decimal(5,2)").alias("discount_pct"),
    )
    model = base.with_tables(
        orders=base.orders.withColumn("customer_id", hot_customer.cast("bigint")).cache(),
        order_items=base.order_items.unionAll(more).repartition(8).cache(),
    )
    model.orders.count(), model.order_items.count()
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield model
    for key in SETTINGS:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def sold(model: RetailModel):
    """Valid lines with everything attached, in pandas."""
    return (
        model.lines.join(model.orders.drop("discount_pct"), "order_id")
        .filter("status NOT IN ('Cancelled', 'Returned')")
        .join(model.customers.drop("is_active"), "customer_id")
        .withColumn("month", month_of("order_date"))
        .select(
            "order_id", "customer_id", "product_id", "segment", "region_id", "month",
            "gross_micros", "net_micros", "status",
        )
        .toPandas()
    )


def final_plan(frame):
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def cents(micros):
    return (int(micros) + 5000) // 10000


def test_detail_splits_the_hot_order(skewed):
    detail = a1_order_details(skewed)
    text = final_plan(detail)
    assert re.search(r"Join\(skew=true\)", text)
    assert detail.count() == len(sold(skewed))


def test_months_split_the_hot_order(skewed):
    frame = e2_monthly_gross(skewed)
    assert re.search(r"Join\(skew=true\)", final_plan(frame))
    lines = sold(skewed)
    expected = lines[lines.status == "Delivered"].groupby("month").gross_micros.sum()
    assert {r.sales_month: int(r.gross_revenue * 10**6) for r in frame.collect()} == dict(expected)


def test_segments(skewed):
    lines = sold(skewed)
    for row in a3_segment_revenue(skewed).collect():
        part = lines[lines.segment == row.segment]
        assert row.total_customers == part.customer_id.nunique()
        assert row.total_orders == part.order_id.nunique()
        assert int(row.total_net_revenue * 100) == cents(part.net_micros.sum())


def test_months_count_distinct_orders_and_buyers(skewed):
    lines = sold(skewed)
    for row in c1_monthly_trend(skewed).collect():
        part = lines[lines.month == row.sales_month]
        assert row.order_count == part.order_id.nunique()
        assert row.unique_customers == part.customer_id.nunique()
        assert int(row.net_revenue * 100) == cents(part.net_micros.sum())


def test_top_products(skewed):
    lines = sold(skewed)
    revenue = lines.groupby(["region_id", "product_id"]).net_micros.sum().map(cents).reset_index()
    revenue["rank"] = revenue.groupby("region_id").net_micros.rank("dense", ascending=False)
    best = revenue[revenue["rank"] <= 3]
    found = d1_top_products_by_region(skewed).collect()
    assert sorted(int(r.net_revenue * 100) for r in found) == sorted(best.net_micros)


def test_quartiles_and_margins_cover_everyone(skewed):
    lines = sold(skewed)
    quartiles = d4_spend_quartiles(skewed)
    assert quartiles.count() == lines.customer_id.nunique()
    sizes = [r["count"] for r in quartiles.groupBy("spend_quartile").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    units = f1_product_margin(skewed).agg(F.sum("units_sold")).first()[0]
    assert units == skewed.order_items.agg(F.sum("quantity")).first()[0]


def test_cohort_start_is_cohort_size(skewed):
    starts = f2_cohort_retention(skewed).filter("months_since_first_order = 0")
    buyers = skewed.kept_orders(Sales.VALID).select("customer_id").distinct().count()
    assert starts.agg(F.sum("active_customers")).first()[0] == buyers


def test_references_are_counted_per_key(skewed):
    assert {row.orphan_rows for row in q_fk(skewed).collect()} == {0}


def test_sums_beyond_64_bits(spark):
    """Two orders of 9 * 10**12 each: their micros do not fit into one bigint sum."""
    big = [(n, n, 1, 90_000, "99999999.99", "0.00") for n in range(1, 4)]
    from hand_model import build_model

    orders = [(n, 1, date(2023, 1, 1), None, "Delivered", "Card", "0.00") for n in range(1, 4)]
    model = build_model(spark, orders=orders, order_items=big)
    total = a3_segment_revenue(model).first().total_net_revenue
    assert total * 100 == 3 * 90_000 * 9_999_999_999
