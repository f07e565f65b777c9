"""Above-average customers, category shares and currently active categories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillscope.functions.measures import (
    Sales,
    amount,
    carried_sums,
    money,
    ratio,
    share_pct,
)
from tillscope.model import RetailModel
from tillscope.plans.frames import customer_sales, listed, product_sales, sold_lines
from tillscope.session import durable


def b1_above_average_customers(model: RetailModel, ordered: bool = False) -> DataFrame:
    """Customers whose spend exceeds the mean spend per buying customer.

    The comparison uses unrounded amounts. The totals per customer are written
    once and read twice, for the mean and for the comparison, so orders and lines
    are scanned once. Runs a job when called.
    """
    spend = durable(customer_sales(model, Sales.VALID).select("customer_id", "net_high", "net_low"))
    # spend > total / buyers, kept exact by multiplying out
    totals = (
        spend.agg(*carried_sums("net"), F.count("*").alias("buyers"))
        .select(F.struct(amount("net").alias("net"), "buyers"))
        .scalar()
    )
    spend = spend.withColumn("net", amount("net"))
    above = spend.filter(
        F.col("net").cast("decimal(25,6)") * totals["buyers"].cast("decimal(13,0)")
        > totals["net"].cast("decimal(38,6)")
    )
    named = (
        above.join(
            model.named_customers.select("customer_id", "customer_name", "segment", "region_id"),
            "customer_id",
        )
        .join(model.regions.select("region_id", "region_name"), "region_id")
        .select(
            "customer_id",
            "customer_name",
            "segment",
            "region_name",
            money("net").alias("lifetime_spend"),
        )
    )
    return named.orderBy(F.desc("lifetime_spend"), "customer_id") if ordered else named


def root_sales(model: RetailModel) -> DataFrame:
    """root_name: units and net of valid sales, one row per root that sold."""
    return (
        product_sales(model)
        .join(model.catalogue.select("product_id", "root_name"), "product_id")
        .groupBy("root_name")
        .agg(F.sum("units").alias("units"), *carried_sums("net"))
        .withColumn("net", amount("net"))
    )


def b2_category_revenue_share(model: RetailModel) -> DataFrame:
    """Units, revenue, mean selling price and revenue share per root category."""
    everything = W.partitionBy()  # a few rows: one per root category
    return (
        root_sales(model)
        .withColumn("total", F.sum("net").over(everything))
        .orderBy(F.desc("net"), "root_name")
        .select(
            F.col("root_name").alias("category_name"),
            F.col("units").alias("total_units_sold"),
            money("net").alias("total_net_revenue"),
            ratio("net", "units").alias("avg_selling_price"),
            share_pct("net", "total").alias("revenue_pct"),
        )
    )


def b3_active_categories(model: RetailModel, as_of: date, months: int = 12) -> DataFrame:
    """Active root categories with a recent valid sale of an active product.

    A product counts for its own category if that is a root, else for the
    category's parent. With that key the existence test is an equi semi join;
    the sold products are made distinct before they meet the catalogue.
    """
    since = F.add_months(F.lit(as_of), -months)
    sold = sold_lines(model, Sales.VALID, since=since).select("product_id").distinct()
    owners = model.categories.select(
        "category_id", F.coalesce("parent_id", "category_id").alias("root_id")
    )
    selling_roots = (
        model.products.filter("is_active")
        .select("product_id", "category_id")
        .join(sold, "product_id", "left_semi")
        .join(owners, "category_id")
        .select(F.col("root_id").alias("category_id"))
        .distinct()
    )
    return (
        model.categories.filter(F.col("parent_id").isNull() & F.col("is_active"))
        .join(selling_roots, "category_id", "left_semi")
        .select("category_id", "category_name", "is_active")
        .transform(listed, "category_name")
    )
