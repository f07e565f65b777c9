"""Best products per region, product margins and weak categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillscope.functions.measures import (
    Sales,
    amount,
    carried_sums,
    line_sums,
    money,
    ratio,
    share_pct,
)
from tillscope.functions.ordering import with_rank
from tillscope.model import RetailModel
from tillscope.plans.frames import listed, sold_lines


def d1_top_products_by_region(model: RetailModel, k: int = 3) -> DataFrame:
    """Products holding the k best revenues of each region; ties share a rank.

    The rank filter is applied inside every task before the exchange on region
    (Spark's group limit), so a region's ranking task sees only candidates.
    """
    # What has no product or region is no candidate for a rank.
    homes = model.customers.select("customer_id", "region_id").join(
        model.regions.select("region_id"), "region_id", "left_semi"
    )
    placed = model.kept_orders(Sales.VALID).join(homes, "customer_id")
    sales = (
        model.join_lines(
            model.lines.select("order_id", "product_id", "net_micros"),
            placed.select("order_id", "region_id"),
            "order_id",
        )
        .groupBy("region_id", "product_id")
        .agg(*line_sums("net"))
        .select("region_id", "product_id", money(amount("net")).alias("net_revenue"))
    )
    sales = sales.join(model.catalogue.select("product_id"), "product_id", "left_semi")
    by_revenue = W.partitionBy("region_id").orderBy(F.desc("net_revenue"))
    best = sales.withColumn("region_rank", F.dense_rank().over(by_revenue)).filter(
        F.col("region_rank") <= k
    )
    return (
        best.join(
            model.catalogue.select("product_id", "product_name", "category_name"), "product_id"
        )
        .join(model.regions.select("region_id", "region_name"), "region_id")
        .select("region_name", "region_rank", "product_name", "category_name", "net_revenue")
        .transform(listed, "region_name", "region_rank", "product_name")
    )


def product_margins(model: RetailModel, valid_only: bool = False) -> DataFrame:
    """Every product with units, gross profit and catalogue margin, unranked.

    Sum(quantity x (line price - cost)) equals sum(gross) - cost x sum(quantity),
    so lines are folded per product before they meet the catalogue.
    """
    lines = sold_lines(model, Sales.VALID) if valid_only else model.lines
    sold = lines.groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold"), *line_sums("gross")
    )
    cost = F.col("unit_cost") * F.col("units_sold").cast("decimal(18,0)")
    return model.catalogue.join(sold, "product_id", "left").select(
        "product_id",
        "product_name",
        "category_name",
        "unit_cost",
        "unit_price",
        share_pct(F.col("unit_price") - F.col("unit_cost"), "unit_price").alias("margin_pct"),
        "units_sold",
        money(amount("gross") - cost).alias("gross_profit"),
    )


def f1_product_margin(
    model: RetailModel, valid_only: bool = False, ordered: bool = False
) -> DataFrame:
    """Margin, units, profit and profit rank of every product.

    By default lines of cancelled and returned orders count too; ``valid_only``
    leaves them out. Products that never sold have a NULL profit, rank first
    and are listed last.
    """
    report = with_rank(
        product_margins(model, valid_only), "gross_profit", "product_id", "profit_rank"
    ).select(
        "product_id",
        "product_name",
        "category_name",
        "unit_cost",
        "unit_price",
        "margin_pct",
        "units_sold",
        "gross_profit",
        "profit_rank",
    )
    return report.orderBy(F.desc_nulls_last("gross_profit"), "product_id") if ordered else report


def f3_underperforming_categories(model: RetailModel, overall_avg: bool = False) -> DataFrame:
    """Root categories selling less than the mean root category.

    The filter compares with the mean over all selling roots. The average and
    the two differences shown are taken over the rows that remain; with
    ``overall_avg`` they use the mean the filter used.
    """
    # (order, root) rows first: the distinct orders of a root are then a plain count
    revenue = (
        model.join_lines(
            sold_lines(model, Sales.VALID),
            model.catalogue.select("product_id", "root_name"),
            "product_id",
        )
        .groupBy("order_id", "root_name")
        .agg(*line_sums("net"))
        .groupBy("root_name")
        .agg(*carried_sums("net"), F.count("*").alias("order_count"))
        .select("root_name", "order_count", money(amount("net")).alias("net_revenue"))
    )
    everything = W.partitionBy()  # a few rows: one per root category
    sums = {"total": F.sum("net_revenue").over(everything), "roots": F.count("*").over(everything)}
    # revenue < total / roots, kept exact by multiplying out
    low = revenue.withColumns(sums).filter(F.col("net_revenue") * F.col("roots") < F.col("total"))
    if not overall_avg:
        low = low.withColumns(sums)
    gap = F.col("net_revenue") * F.col("roots") - F.col("total")
    return low.orderBy("net_revenue", "root_name").select(
        F.col("root_name").alias("category_name"),
        "net_revenue",
        "order_count",
        ratio("total", "roots").alias("avg_category_revenue"),
        ratio(gap, "roots").alias("vs_average"),
        share_pct(gap, "total").alias("pct_vs_average"),
    )
