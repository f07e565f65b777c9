"""Lifetime value, spend quartiles, top spenders and cohort retention."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.measures import (
    Sales,
    amount,
    carried_sums,
    money,
    month_number,
    month_of,
    ratio,
    yearly_rate,
)
from tillscope.functions.ordering import tile_cuts, tile_of, with_ntile
from tillscope.model import RetailModel
from tillscope.plans.frames import customer_sales, listed
from tillscope.session import durable


@dataclass(frozen=True)
class Tiers:
    """Thresholds of the recency / spend tiers."""

    champion_spend: int = 5000
    loyal_spend: int = 2000
    fresh_days: int = 90
    loyal_days: int = 180
    risk_days: int = 365

    def label(self, spend: Column, days: Column) -> Column:
        """The first matching tier wins."""
        return (
            F.when((spend >= self.champion_spend) & (days <= self.fresh_days), "Champions")
            .when((spend >= self.loyal_spend) & (days <= self.loyal_days), "Loyal Customers")
            .when(days <= self.fresh_days, "Recent Customers")
            .when(days.between(self.fresh_days + 1, self.risk_days), "At Risk")
            .otherwise("Lost")
        )


# Tier labels, lowest quartile first, inner spaces included.
SPEND_TIERS = (
    "Low Spender    (Q1)",
    "Mid Spender    (Q2)",
    "High Spender   (Q3)",
    "Top Spender    (Q4)",
)


def customer_history(model: RetailModel) -> DataFrame:
    """One row per customer with valid spend: net, all valid orders, first and last date.

    Spend, frequency and recency come out of a single grouping on customer.
    Orders without lines count as orders but carry no amount; customers who
    have only such orders have no spend row and are left out.
    """
    return (
        model.kept_orders(Sales.VALID)
        .select("order_id", "customer_id", "order_date")
        .join(model.order_totals, "order_id", "left")
        .groupBy("customer_id")
        .agg(
            *carried_sums("net"),
            F.sum("lines").alias("lines"),
            F.count("*").alias("orders"),
            F.count("lines").alias("sold_orders"),
            F.min("order_date").alias("first_date"),
            F.max("order_date").alias("last_date"),
        )
        .filter(F.col("lines") > 0)
        .withColumn("net", amount("net"))
    )


def with_value_estimate(history: DataFrame) -> DataFrame:
    """Add lifetime_spend, avg_order_value, orders_per_year and clv_3yr_estimate."""
    lifespan = F.datediff("last_date", "first_date")
    estimate = (
        F.col("avg_order_value").cast("decimal(18,2)")
        * F.col("orders_per_year").cast("decimal(16,2)")
        * F.lit(3)
    )
    return history.withColumns(
        {
            "lifetime_spend": money("net"),
            "avg_order_value": ratio("net", "orders"),
            "orders_per_year": yearly_rate("orders", lifespan),
        }
    ).withColumn("clv_3yr_estimate", money(estimate))


def c3_customer_lifetime_value(
    model: RetailModel, as_of: date, tiers: Tiers = Tiers(), ordered: bool = False
) -> DataFrame:
    """Spend, frequency, recency, a three-year value estimate and a tier.

    The estimate multiplies the already rounded mean order value and yearly
    rate. A customer whose orders fall on one day has no rate and no estimate.
    """
    scored = with_value_estimate(customer_history(model)).join(
        model.named_customers.select("customer_id", "customer_name", "segment"), "customer_id"
    )
    report = scored.withColumn(
        "days_since_last_order", F.datediff(F.lit(as_of), "last_date")
    ).select(
        "customer_id",
        "customer_name",
        "segment",
        "lifetime_spend",
        F.col("orders").alias("total_orders"),
        "avg_order_value",
        "orders_per_year",
        "days_since_last_order",
        "clv_3yr_estimate",
        tiers.label(F.col("lifetime_spend"), F.col("days_since_last_order")).alias("rfm_tier"),
    )
    if ordered:
        return report.orderBy(F.desc_nulls_first("clv_3yr_estimate"), "customer_id")
    return report


def placed_spend(model: RetailModel) -> DataFrame:
    """customer_id, total_spend in cents, of the buying customers that take a place in a tile.

    Those that don't exist, or whose region doesn't, take none.
    """
    spend = customer_sales(model, Sales.VALID).select(
        "customer_id", money("net").alias("total_spend")
    )
    placed = model.customers.select("customer_id", "region_id").join(
        model.regions.select("region_id"), "region_id", "left_semi"
    )
    return spend.join(placed, "customer_id", "left_semi")


def spend_quartiles(model: RetailModel) -> DataFrame:
    """customer_id, total_spend in cents, spend_quartile 1..4 (4 = highest)."""
    order = [F.asc("total_spend"), F.asc("customer_id")]
    return with_ntile(placed_spend(model), 4, order, "spend_quartile")


def d4_spend_quartiles(model: RetailModel, ordered: bool = False) -> DataFrame:
    """Buying customers in four equal spend groups, ties broken by customer_id."""
    labels = F.array(*[F.lit(label) for label in SPEND_TIERS])
    tiles = (
        spend_quartiles(model)
        .join(
            model.named_customers.select(
                "customer_id",
                "customer_name",
                F.col("segment").alias("crm_segment"),
                "region_id",
            ),
            "customer_id",
        )
        .join(model.regions.select("region_id", "region_name"), "region_id")
        .select(
            "customer_id",
            "customer_name",
            "crm_segment",
            "region_name",
            "total_spend",
            "spend_quartile",
            F.element_at(labels, F.col("spend_quartile").cast("int")).alias("spend_tier"),
        )
    )
    return tiles.orderBy(F.desc("total_spend"), "customer_id") if ordered else tiles


def e1_top_customers_correlated(
    model: RetailModel,
    k: int = 10,
    nulls: str = "last",
    sales: Sales = Sales.DELIVERED,
    shown: str = "customer_name",
) -> DataFrame:
    """Top customers by unrounded delivered gross, non-buyers included as NULL.

    ``nulls='first'`` lists the customers without delivered orders on top;
    ``shown`` is the column that names a customer.
    """
    spend = customer_sales(model, sales).select(
        "customer_id", F.col("gross").alias("total_spend")
    )
    by_spend = F.desc_nulls_last("total_spend") if nulls == "last" else F.desc_nulls_first(
        "total_spend"
    )
    return (
        model.named_customers.select("customer_id", shown)
        .join(spend, "customer_id", "left")
        .orderBy(by_spend, "customer_id")
        .limit(k)
    )


def e1_top_customers_preagg(
    model: RetailModel,
    k: int = 10,
    rounded: bool = True,
    sales: Sales = Sales.DELIVERED,
    shown: str = "customer_name",
) -> DataFrame:
    """Top buying customers by delivered gross, from totals per customer.

    Totals of customers that don't exist are left out before the k best are taken.
    """
    totals = customer_sales(model, sales).select("customer_id", "gross")
    total = money("gross") if rounded else F.col("gross")
    return (
        model.named_customers.select("customer_id", shown)
        .join(totals, "customer_id")
        .orderBy(F.desc("gross"), "customer_id")
        .limit(k)
        .select("customer_id", shown, total.alias("total_spend"))
    )


def f2_cohort_retention(model: RetailModel, months: int = 12) -> DataFrame:
    """Active customers per cohort month and whole months since the first order.

    Orders are folded to each customer's set of months, which the length of the
    history bounds; the cohort is its least, and the distinct customers are a
    plain count. The only exchange at customer grain is that of the sets.
    """
    activity = (
        model.kept_orders(Sales.VALID)
        .groupBy("customer_id")
        .agg(F.collect_set(month_of("order_date")).alias("months"))
        .select(
            F.array_min("months").alias("cohort_month"),
            F.explode("months").alias("activity_month"),
        )
    )
    offset = month_number("activity_month") - month_number("cohort_month")
    return (
        activity.withColumn("months_since_first_order", offset)
        .filter(F.col("months_since_first_order") < months)
        .groupBy("cohort_month", "months_since_first_order")
        .agg(F.count("*").alias("active_customers"))
        .transform(listed, "cohort_month", "months_since_first_order")
    )


def vc3_clv_ntile(model: RetailModel, k: int = 10) -> DataFrame:
    """Top customers by value over orders of every status, tiered by value quartile.

    The mean order value stays unrounded. The value of each customer is written once,
    for the three cuts between the quartiles and for the list; customers are neither
    sorted nor numbered. Runs jobs when called.
    """
    value = durable(
        customer_sales(model, Sales.ANY).select(
            "customer_id", "orders", F.col("net").alias("lifetime_value")
        )
    )
    cuts = tile_cuts(value, 4, "lifetime_value", "customer_id")
    return (
        model.named_customers.select("customer_id", "customer_name")
        .join(value, "customer_id")
        .withColumn("quartile", tile_of(cuts, "lifetime_value", "customer_id"))
        .orderBy(F.desc("lifetime_value"), "customer_id")
        .limit(k)
        .select(
            "customer_id",
            F.col("customer_name").alias("customer"),
            "lifetime_value",
            "orders",
            (F.col("lifetime_value").cast("double") / F.col("orders")).alias("avg_order"),
            F.when(F.col("quartile") == 4, "High Value")
            .when(F.col("quartile") == 3, "Medium")
            .otherwise("Low Value")
            .alias("clv_segment"),
        )
    )
