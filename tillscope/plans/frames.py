"""Shared base frames. The grain of each one decides what has to be shuffled.

Where orders are counted, lines are summed per order *before* they meet the
orders: partial aggregation folds an oversized order inside the map tasks, the
exchange on ``order_id`` that the join needs anyway carries at most one row per
order and task, and everything above (customer, segment, region) reads these
totals. Since an order appears once, COUNT(DISTINCT order) is a plain count from
there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.measures import (
    Sales,
    amount,
    carried_sums,
    counted,
    line_sums,
    month_of,
)
from tillscope.model import RetailModel


def order_sales(model: RetailModel, sales: Sales) -> DataFrame:
    """One row per kept order with lines: its customer, date, month and totals."""
    return (
        model.kept_orders(sales)
        .select(*model.line_keys, "customer_id", "order_date")
        .join(model.keyed_totals, list(model.line_keys))
        .withColumn("sales_month", month_of("order_date"))
    )


def customer_sales(model: RetailModel, sales: Sales) -> DataFrame:
    """One row per customer with sold lines: orders, lines, units, gross, net."""
    return (
        order_sales(model, sales)
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.sum("lines").alias("lines"),
            F.sum("units").alias("units"),
            *carried_sums("gross", "net"),
        )
        .withColumns({"gross": amount("gross"), "net": amount("net")})
    )


def listed(report: DataFrame, *order: Column | str) -> DataFrame:
    """A report of few rows (months, regions, segments, roots) in listing order.

    A global ``orderBy`` samples its input first and so runs the report's last
    aggregate twice. These rows fit into any one task: they are sent there and sorted.
    """
    return report.repartition(1).sortWithinPartitions(*order)


def sold_lines(
    model: RetailModel, sales: Sales, *order_columns: str, since: Column | None = None
) -> DataFrame:
    """Lines of kept orders, with the named order columns added.

    Needed where the product matters, so nothing can be summed beforehand; an
    oversized order is dealt out by a model that knows its hot keys, and left to
    the adaptive skew-join split by others.
    """
    keys = model.line_keys
    lines = model.keyed_lines.select(*keys, "product_id", "quantity", "gross_micros", "net_micros")
    added = [c for c in order_columns if c not in keys]
    orders = model.kept_orders(sales, since).select(*keys, *added)
    return model.join_lines(lines, orders, "order_id", "inner" if added else "left_semi")


def month_sales(model: RetailModel, sales: Sales) -> DataFrame:
    """One row per month with sold lines: gross, net.

    Only sums are wanted, so the joined lines go straight into the month's
    partial aggregate; folding them per order first would cost more than it
    saves, unless the folded lines, or the sums of months, are at hand already.
    """
    if model.month_sums is not None:
        grouped = model.month_sums.filter(counted(sales)).groupBy("sales_month")
        months = grouped.agg(*carried_sums("gross", "net"))
    elif model.totals_stored:
        grouped = order_sales(model, sales).groupBy("sales_month")
        months = grouped.agg(*carried_sums("gross", "net"))
    else:
        lines = sold_lines(model, sales, "order_date")
        grouped = lines.groupBy(month_of("order_date").alias("sales_month"))
        months = grouped.agg(*line_sums("gross", "net"))
    return months.withColumns({"gross": amount("gross"), "net": amount("net")})


def product_sales(model: RetailModel) -> DataFrame:
    """One row per product with valid sales: units, net."""
    return (
        sold_lines(model, Sales.VALID)
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), *line_sums("net"))
        .withColumn("net", amount("net"))
    )


def region_month_sales(model: RetailModel) -> DataFrame:
    """region_name x sales_month: net of valid sales, unrounded."""
    return (
        order_sales(model, Sales.VALID)
        .join(model.customers.select("customer_id", "region_id"), "customer_id")
        .groupBy("region_id", "sales_month")
        .agg(*carried_sums("net"))
        .join(model.regions.select("region_id", "region_name"), "region_id")
        .select("region_name", "sales_month", amount("net").alias("net"))
    )
