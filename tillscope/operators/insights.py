"""Figures of the written business report, which come without a query.

The definitions are therefore ours; each docstring states the one used.
"""

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
from tillscope.functions.ordering import tile_cuts, tile_of
from tillscope.model import RetailModel
from tillscope.operators.customers import customer_history, placed_spend, with_value_estimate
from tillscope.operators.trends import d2_month_over_month, rounded_months
from tillscope.plans.frames import (
    customer_sales,
    listed,
    product_sales,
    region_month_sales,
)
from tillscope.session import durable


def _all() -> WindowSpec:
    """Every row; used on report rows only: segments and quartiles."""
    return W.partitionBy()


def i1_top_products(model: RetailModel, k: int = 5) -> DataFrame:
    """Best products by net revenue of valid sales, with units and catalogue margin."""
    return (
        model.catalogue.join(product_sales(model), "product_id")
        .orderBy(F.desc("net"), "product_id")
        .limit(k)
        .select(
            "product_id",
            "product_name",
            "category_name",
            F.col("units").alias("units_sold"),
            money("net").alias("net_revenue"),
            share_pct(F.col("unit_price") - F.col("unit_cost"), "unit_price").alias("margin_pct"),
        )
    )


def i2_region_year(model: RetailModel) -> DataFrame:
    """Net revenue per region and year, its share of the year, growth on the year before."""
    year = W.partitionBy("sales_year")
    history = W.partitionBy("region_name").orderBy("sales_year")
    year_before = F.when(
        F.lag("sales_year").over(history) == F.col("sales_year") - 1,
        F.lag("net_revenue").over(history),
    )
    return (
        region_month_sales(model)
        .groupBy("region_name", F.year("sales_month").cast("bigint").alias("sales_year"))
        .agg(money(F.sum("net")).alias("net_revenue"))
        .select(
            "region_name",
            "sales_year",
            "net_revenue",
            share_pct("net_revenue", F.sum("net_revenue").over(year)).alias("pct_of_year"),
            growth_pct("net_revenue", year_before, 1).alias("yoy_pct"),
        )
        .transform(listed, "region_name", "sales_year")
    )


def i3_segment_profile(model: RetailModel) -> DataFrame:
    """All customers of a segment, their revenue, order value and mean CLV estimate.

    The mean leaves out customers without an estimate; the order value divides
    by orders that have lines.
    """
    history = with_value_estimate(customer_history(model)).select(
        "customer_id", "net_high", "net_low", "sold_orders", "clv_3yr_estimate"
    )
    return (
        model.customers.select("customer_id", "segment")
        .join(history, "customer_id", "left")
        .groupBy("segment")
        .agg(
            F.count("*").alias("customers"),
            *carried_sums("net"),
            F.sum("sold_orders").alias("orders"),
            F.sum("clv_3yr_estimate").alias("clv"),
            F.count("clv_3yr_estimate").alias("estimates"),
        )
        .withColumn("net", amount("net"))
        .select(
            "segment",
            "customers",
            share_pct("customers", F.sum("customers").over(_all())).alias("pct_of_base"),
            money(F.coalesce("net", F.lit(0))).alias("total_net_revenue"),
            share_pct(F.coalesce("net", F.lit(0)), F.sum("net").over(_all())).alias("revenue_pct"),
            ratio("net", "orders").alias("avg_order_value"),
            ratio("clv", "estimates").alias("avg_clv_3yr"),
        )
        .orderBy(F.desc("total_net_revenue"), "segment")
    )


def i4_quartile_share(model: RetailModel) -> DataFrame:
    """Share of total spend held by each spend quartile.

    Two columns per customer are written once, for the three exact cuts between the
    quartiles and for the sums; customers are neither sorted nor numbered. Runs jobs when
    called.
    """
    spend = durable(placed_spend(model))
    cuts = tile_cuts(spend, 4, "total_spend", "customer_id")
    return (
        spend.groupBy(tile_of(cuts, "total_spend", "customer_id").alias("spend_quartile"))
        .agg(F.count("*").alias("customers"), F.sum("total_spend").alias("spend"))
        .select(
            "spend_quartile",
            "customers",
            money("spend").alias("total_spend"),
            share_pct("spend", F.sum("spend").over(_all())).alias("revenue_pct"),
        )
        .transform(listed, "spend_quartile")
    )


def i5_quarter_growth(model: RetailModel) -> DataFrame:
    """Mean month-over-month growth (as reported, in percent) per calendar quarter."""
    return (
        d2_month_over_month(model)
        .filter(F.col("mom_growth_pct").isNotNull())
        .groupBy(F.quarter("sales_month").cast("bigint").alias("quarter"))
        .agg(F.count("*").alias("months"), F.sum("mom_growth_pct").alias("growth"))
        .select("quarter", "months", ratio("growth", "months").alias("avg_mom_growth_pct"))
        .transform(listed, "quarter")
    )


def i6_peak_trough_month(model: RetailModel) -> DataFrame:
    """Months with the highest or the lowest revenue of their year; ties are kept."""
    year = W.partitionBy("sales_year")
    return (
        rounded_months(model)
        .withColumn("sales_year", F.year("sales_month").cast("bigint"))
        .withColumn("is_peak", F.col("net_revenue") == F.max("net_revenue").over(year))
        .withColumn("is_trough", F.col("net_revenue") == F.min("net_revenue").over(year))
        .filter("is_peak OR is_trough")
        .select("sales_year", "sales_month", "net_revenue", "is_peak", "is_trough")
        .transform(listed, "sales_year", "sales_month")
    )


def i7_leaf_underperformers(model: RetailModel) -> DataFrame:
    """Categories without children that sell less than the mean such category.

    A leaf without sales counts as zero, in the mean and in the list. The leaves'
    revenue is written once, for their mean and for the list. Runs a job when called.
    """
    parents = model.categories.select(F.col("parent_id").alias("category_id"))
    leaves = model.categories.join(parents, "category_id", "left_anti")
    revenue = (
        product_sales(model)
        .join(model.products.select("product_id", "category_id"), "product_id")
        .groupBy("category_id")
        .agg(*carried_sums("net"))
        .withColumn("net", amount("net"))
    )
    scored = durable(
        leaves.join(revenue, "category_id", "left").select(
            "category_id",
            "category_name",
            "is_active",
            money(F.coalesce("net", F.lit(0))).alias("net_revenue"),
        )
    )
    whole = scored.agg(
        F.struct(F.sum("net_revenue").alias("total"), F.count("*").alias("leaves"))
    ).scalar()
    scored = scored.withColumns({"total": whole["total"], "leaves": whole["leaves"]})
    gap = F.col("net_revenue") * F.col("leaves") - F.col("total")
    return (
        scored.filter(gap < 0)
        .orderBy("net_revenue", "category_id")
        .select(
            "category_id",
            "category_name",
            "is_active",
            "net_revenue",
            ratio("total", "leaves").alias("category_average"),
            share_pct(gap, "total").alias("gap_pct"),
        )
    )


def i8_segment_uplift(
    model: RetailModel, source: str = "Bronze", target: str = "Silver", converted_pct: int = 10
) -> DataFrame:
    """Extra revenue if ``converted_pct`` of one segment spent like another.

    converted customers x (mean revenue per customer of target - of source),
    with the two means as shown, rounded to cents.
    """
    segments = (
        model.customers.filter(F.col("segment").isin(source, target))
        .select("customer_id", "segment")
        .join(customer_sales(model, Sales.VALID), "customer_id", "left")
        .groupBy("segment")
        .agg(F.count("*").alias("customers"), *carried_sums("net"))
        .select("segment", "customers", ratio(amount("net"), "customers").alias("per_customer"))
    )

    def of(segment: str, column: str):
        return F.max(F.when(F.col("segment") == segment, F.col(column)))

    gap = F.col("target_revenue_per_customer") - F.col("source_revenue_per_customer")
    converted = F.col("source_customers").cast("decimal(12,0)") * F.lit(converted_pct)
    return segments.agg(
        of(source, "customers").alias("source_customers"),
        of(source, "per_customer").alias("source_revenue_per_customer"),
        of(target, "per_customer").alias("target_revenue_per_customer"),
    ).select(
        F.lit(source).alias("source_segment"),
        F.lit(target).alias("target_segment"),
        "source_customers",
        "source_revenue_per_customer",
        "target_revenue_per_customer",
        ratio(converted * gap, F.lit(100)).alias("revenue_uplift"),
    )
