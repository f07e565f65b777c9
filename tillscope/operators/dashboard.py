"""The dashboard's readings of the analyses: other columns, filters or precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.measures import Sales, line_amount, money, ratio
from tillscope.model import RetailModel
from tillscope.operators.counts import g7_row_counts
from tillscope.operators.customers import e1_top_customers_correlated, e1_top_customers_preagg
from tillscope.operators.joins import order_lines, segment_totals
from tillscope.operators.products import d1_top_products_by_region
from tillscope.operators.trends import c1_monthly_trend, d2_month_over_month
from tillscope.plans.frames import listed


def va1_order_listing(model: RetailModel, ordered: bool = False) -> DataFrame:
    """Seven columns of the order detail; ``ordered`` sorts by date, then by order."""
    order = (F.desc("order_date"), "order_id") if ordered else ()
    return order_lines(model, *order).select(
        "order_id",
        "customer_name",
        "region_name",
        "product_name",
        "category_name",
        "quantity",
        line_amount("net_micros").alias("net_revenue"),
    )


def va3_segment_revenue_all(model: RetailModel) -> DataFrame:
    """Segment revenue over orders of every status."""
    return (
        segment_totals(model, Sales.ANY)
        .transform(listed, F.desc("net"), "segment")
        .select(
            "segment",
            F.col("customers").alias("total_customers"),
            F.col("orders").alias("total_orders"),
            money("net").alias("total_revenue"),
            ratio("net", "orders").alias("avg_order_value"),
        )
    )


def vc1_running_total(model: RetailModel) -> DataFrame:
    """Monthly revenue with its running total."""
    return c1_monthly_trend(model).select(
        F.col("sales_month").alias("month"),
        F.col("net_revenue").alias("monthly_revenue"),
        F.col("cumulative_revenue").alias("running_total"),
    )


def vd1_top_products(model: RetailModel) -> DataFrame:
    """Top three products per region, without the category."""
    return d1_top_products_by_region(model).select(
        "region_name",
        "product_name",
        "net_revenue",
        F.col("region_rank").alias("rank_in_region"),
    )


def vd2_growth_direction(model: RetailModel) -> DataFrame:
    """Growth to one decimal, with an arrow for its direction."""
    growth = F.col("mom_growth_pct")
    return d2_month_over_month(model, scale=1).select(
        F.col("sales_month").alias("month"),
        "net_revenue",
        F.col("prev_month_revenue").alias("prev_month_rev"),
        "mom_growth_pct",
        F.when(growth > 0, "▲").when(growth < 0, "▼").when(growth == 0, "→").alias("direction"),
    )


def ve1_top_customers_nulls_first(model: RetailModel, k: int = 10) -> DataFrame:
    """Top customers with the customers that have no delivered order on top."""
    return e1_top_customers_correlated(model, k, nulls="first", shown="first_name")


def ve1_top_customers_unrounded(model: RetailModel, k: int = 10) -> DataFrame:
    """Top buying customers with their unrounded total."""
    return e1_top_customers_preagg(model, k, rounded=False, shown="first_name")


def vst_stat_strip(model: RetailModel) -> DataFrame:
    """Number of tables and of rows in them."""
    counts = g7_row_counts(model, total=False)
    return counts.agg(F.sum("rows").alias("total_rows"), F.count("*").alias("tables"))
