"""Sales over time. Windows here run over months, never over orders or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillscope.functions.measures import (
    Sales,
    amount,
    carried_sums,
    growth_pct,
    money,
    ratio,
    share_pct,
)
from tillscope.model import RetailModel
from tillscope.plans.frames import listed, month_sales, order_sales, region_month_sales


def _in_time() -> WindowSpec:
    return W.orderBy("sales_month")


def c1_monthly_trend(model: RetailModel) -> DataFrame:
    """Revenue, orders, buyers, mean order value and running revenue per month.

    Orders are first folded to (month, customer), which makes the distinct
    buyers a plain count. The running total adds up unrounded months.
    """
    months = (
        order_sales(model, Sales.VALID)
        .groupBy("sales_month", "customer_id")
        .agg(F.count("*").alias("orders"), *carried_sums("net"))
        .groupBy("sales_month")
        .agg(
            F.sum("orders").alias("orders"),
            F.count("*").alias("buyers"),
            *carried_sums("net"),
        )
        .withColumn("net", amount("net"))
    )
    so_far = _in_time().rangeBetween(W.unboundedPreceding, W.currentRow)
    return months.select(
        "sales_month",
        money("net").alias("net_revenue"),
        F.col("orders").alias("order_count"),
        F.col("buyers").alias("unique_customers"),
        ratio("net", "orders").alias("avg_order_value"),
        money(F.sum("net").over(so_far)).alias("cumulative_revenue"),
    ).orderBy("sales_month")


def rounded_months(model: RetailModel) -> DataFrame:
    return month_sales(model, Sales.VALID).select(
        "sales_month", money("net").alias("net_revenue")
    )


def d2_month_over_month(model: RetailModel, scale: int = 2) -> DataFrame:
    """Each month beside its neighbours, growth in percent and a three-row mean.

    Neighbours are adjacent rows: a month without sales is not filled in. All
    columns are derived from months already rounded to cents.
    """
    previous = F.lag("net_revenue").over(_in_time())
    last_three = _in_time().rowsBetween(-2, W.currentRow)
    return (
        rounded_months(model)
        .select(
            "sales_month",
            "net_revenue",
            previous.alias("prev_month_revenue"),
            F.lead("net_revenue").over(_in_time()).alias("next_month_revenue"),
            F.sum("net_revenue").over(last_three).alias("recent"),
            F.count("net_revenue").over(last_three).alias("recent_rows"),
        )
        .select(
            "sales_month",
            "net_revenue",
            "prev_month_revenue",
            "next_month_revenue",
            growth_pct("net_revenue", "prev_month_revenue", scale).alias("mom_growth_pct"),
            ratio("recent", "recent_rows").alias("rolling_3mo_avg"),
        )
        .orderBy("sales_month")
    )


def d3_region_running_total(model: RetailModel) -> DataFrame:
    """Running revenue per region over the whole history, and each month's share."""
    region = W.partitionBy("region_name")
    so_far = region.orderBy("sales_month").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        region_month_sales(model)
        .withColumn("net_revenue", money("net"))
        .select(
            "region_name",
            "sales_month",
            "net_revenue",
            money(F.sum("net_revenue").over(so_far)).alias("running_total"),
            share_pct("net_revenue", F.sum("net_revenue").over(region)).alias(
                "pct_of_region_total"
            ),
        )
        .transform(listed, "region_name", "sales_month")
    )


def e2_monthly_gross(model: RetailModel, sales: Sales = Sales.DELIVERED) -> DataFrame:
    """Unrounded gross of delivered orders per month."""
    return (
        month_sales(model, sales)
        .select("sales_month", F.col("gross").alias("gross_revenue"))
        .transform(listed, "sales_month")
    )


def e2_monthly_gross_preproject(model: RetailModel, sales: Sales = Sales.DELIVERED) -> DataFrame:
    """The same months, rounded to cents.

    Projecting the line amount before the aggregate changes nothing here, Spark
    plans both alike. What an index on delivered orders does for this report is
    done by the stored layout: folders by status, files sorted by date.
    """
    return (
        month_sales(model, sales)
        .select("sales_month", money("gross").alias("gross_revenue"))
        .transform(listed, "sales_month")
    )
