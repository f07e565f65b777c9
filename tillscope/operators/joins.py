"""Enriched order detail, dormant customers and revenue by segment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.measures import (
    Sales,
    amount,
    carried_sums,
    line_amount,
    money,
    ratio,
)
from tillscope.model import RetailModel
from tillscope.plans.frames import customer_sales, listed


#: Customers and products that are looked up by every task, at most: names of some 100 MB.
MOST_LOOKED_UP = 500_000


def order_lines(model: RetailModel, *order: Column | str) -> DataFrame:
    """Every valid order line with the names of its customer, region, product and leaf category.

    Unordered, the joins are bushy: headers meet customers and products their
    categories first, so the lines, by far the largest side, move at most twice.

    With an ``order`` (of line and order columns) only ids and amounts are sorted;
    names are added to the sorted rows by lookups, which keep their order and
    move none of them. That asks for names that fit into every task, so their
    rows are counted first (which runs a job); where they are too many, the names
    are joined before the sort.
    """
    orders = model.kept_orders(Sales.VALID).select(
        "order_id", "customer_id", "order_date", "status"
    )
    buyers = model.named_customers.select(
        "customer_id", "customer_name", F.col("segment").alias("customer_segment"), "region_id"
    ).join(model.regions.select("region_id", "region_name"), "region_id")
    goods = model.catalogue.select("product_id", "product_name", "category_name")
    looked_up = order and all(
        table.count() <= MOST_LOOKED_UP for table in (model.customers, model.products)
    )
    if looked_up:
        # A position in the sorted rows is asked for, or the sort would be dropped
        # as one whose order no join needs.
        placed = (
            model.join_lines(model.lines, orders, "order_id")
            .orderBy(*order)
            .withColumn("_at", F.monotonically_increasing_id())
        )
        return (
            placed.join(F.broadcast(buyers), "customer_id")
            .join(F.broadcast(goods), "product_id")
            .where("_at >= 0")
        )
    headers = orders.join(buyers, "customer_id")
    detail = model.join_lines(model.lines, headers, "order_id")
    detail = model.join_lines(detail, goods, "product_id")
    return detail.orderBy(*order) if order else detail


def a1_order_details(model: RetailModel, ordered: bool = False) -> DataFrame:
    """Every valid order line with its customer, region, product and leaf category.

    ``ordered`` lists the newest order first, an order's lines by number.
    """
    order = (F.desc("order_date"), "order_id", "order_item_id") if ordered else ()
    return order_lines(model, *order).select(
        "order_id",
        "order_date",
        "status",
        "customer_id",
        "customer_name",
        "customer_segment",
        "region_name",
        "product_id",
        "product_name",
        "category_name",
        "quantity",
        "unit_price",
        "discount_pct",
        line_amount("gross_micros").alias("gross_revenue"),
        line_amount("net_micros").alias("net_revenue"),
    )


def a2_customers_without_orders(
    model: RetailModel,
    as_of: date,
    since: date | None = None,
    sales: Sales = Sales.ANY,
    ordered: bool = False,
) -> DataFrame:
    """Active customers who never ordered, whatever became of an order.

    ``since`` and ``sales`` narrow what counts as an order. The ordering
    customers are made distinct before the anti join, so a customer with very
    many orders is one row when it reaches the exchange.
    """
    orders = model.kept_orders(sales, None if since is None else F.lit(since))
    buyers = orders.select("customer_id").distinct()
    dormant = (
        model.named_customers.filter("is_active")
        .join(buyers, "customer_id", "left_anti")
        .join(model.regions.select("region_id", "region_name"), "region_id")
        .select(
            "customer_id",
            "customer_name",
            "email",
            "segment",
            "region_name",
            "date_joined",
            F.datediff(F.lit(as_of), "date_joined").alias("days_since_joined"),
        )
    )
    return dormant.orderBy("date_joined", "customer_id") if ordered else dormant


def segment_totals(model: RetailModel, sales: Sales) -> DataFrame:
    """segment: buying customers, orders, lines and net, without any DISTINCT."""
    return (
        customer_sales(model, sales)
        .join(model.customers.select("customer_id", "segment"), "customer_id")
        .groupBy("segment")
        .agg(
            F.count("*").alias("customers"),
            F.sum("orders").alias("orders"),
            F.sum("lines").alias("lines"),
            *carried_sums("net"),
        )
        .withColumn("net", amount("net"))
    )


def a3_segment_revenue(model: RetailModel) -> DataFrame:
    """Customers, orders, revenue, mean line and mean order value per segment."""
    return (
        segment_totals(model, Sales.VALID)
        .transform(listed, F.desc("net"), "segment")
        .select(
            "segment",
            F.col("customers").alias("total_customers"),
            F.col("orders").alias("total_orders"),
            money("net").alias("total_net_revenue"),
            ratio("net", "lines").alias("avg_line_revenue"),
            ratio("net", "orders").alias("avg_order_value"),
        )
    )
