"""Synthetic customers, orders and lines of any size, on executors only.

Every row is a function of its own sequence number ``n``, so the tables can be
made at 12 thousand or 12 billion rows by changing the length of the sequence,
and are the same on every run. A sequence is any DataFrame with a column ``n``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.model import RetailModel
from tillscope.sources.catalogue import (
    EMAIL_PARTS,
    FIRST_NAMES,
    LAST_NAMES,
    PAYMENT_CYCLE,
    PHONE_PREFIX,
    STATUS_CYCLE,
    gen_categories,
    gen_products,
    gen_regions,
)

# Size and calendar of the standard data set.
CUSTOMERS = 2000
ORDERS = 12000
PRODUCT_SLOTS = 80  # more slots than products: lines that hit an empty slot vanish
ORDER_DAYS = 1460
JOIN_DAYS = 1826
FIRST_ORDER = date(2020, 1, 1)
FIRST_JOIN = date(2019, 1, 1)
PRODUCT_STRIDE = 1009
LINE_STRIDE = 7


def sequence(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(1, rows + 1).toDF("n")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at a 0-based index that wraps around."""
    slot = (index % len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(value) for value in values]), slot)


def _day(start: date, offset: Column) -> Column:
    return F.date_add(F.lit(start), offset.cast("int"))


def gen_customers(seq: DataFrame) -> DataFrame:
    """Customers before reclassification: half Bronze, 30 % Silver, 20 % Gold."""
    n = F.col("n")
    digit = n % 10
    before, after = EMAIL_PARTS
    return seq.select(
        n.alias("customer_id"),
        _pick(FIRST_NAMES, n - 1).alias("first_name"),
        _pick(LAST_NAMES, n - 1).alias("last_name"),
        F.concat(F.lit(before), n, F.lit(after)).alias("email"),
        F.concat(F.lit(PHONE_PREFIX), F.lpad((n % 10000).cast("string"), 4, "0")).alias("phone"),
        (n % 6 + 1).alias("region_id"),
        F.when(digit < 5, "Bronze").when(digit < 8, "Silver").otherwise("Gold").alias("segment"),
        _day(FIRST_JOIN, n % JOIN_DAYS).alias("date_joined"),
        (n % 25 != 0).alias("is_active"),
    )


def reclassify_platinum(customers: DataFrame, every: int = 20) -> DataFrame:
    """Every 20th customer becomes Platinum, whatever the segment was."""
    promoted = F.col("customer_id") % every == 0
    return customers.withColumn("segment", F.when(promoted, "Platinum").otherwise(F.col("segment")))


def gen_orders(seq: DataFrame, customers: int = CUSTOMERS) -> DataFrame:
    """Orders dealt out to the customers in turn over four years."""
    n = F.col("n")
    ordered_on = _day(FIRST_ORDER, n % ORDER_DAYS)
    shipped_on = F.date_add(ordered_on, (n % 5).cast("int") + 1)
    percent = F.when(n % 8 == 0, 10).when(n % 8 == 1, 5).otherwise(0)
    return seq.select(
        n.alias("order_id"),
        (n % customers + 1).alias("customer_id"),
        ordered_on.alias("order_date"),
        F.when(n % 7 != 0, shipped_on).alias("shipped_date"),
        _pick(STATUS_CYCLE, n).alias("status"),
        _pick(PAYMENT_CYCLE, n).alias("payment_method"),
        percent.cast("decimal(5,2)").alias("discount_pct"),
    )


def gen_order_items(orders: DataFrame, products: DataFrame) -> DataFrame:
    """One to four lines per order, priced at catalogue price less the order's discount.

    The same discount is stored on the line again. The id is made from the
    order's, so no global numbering is needed; ids of vanished lines are gaps.
    """
    order_id, line = F.col("order_id"), F.col("line")
    lines = orders.select(
        "order_id",
        "discount_pct",
        F.explode(F.sequence(F.lit(1), (4 - order_id % 4).cast("int"))).alias("line"),
    )
    slot = (order_id * PRODUCT_STRIDE + line * LINE_STRIDE) % PRODUCT_SLOTS + 1
    price = F.col("list_price") * (100 - F.col("discount_pct")) / 100
    return (
        lines.withColumn("product_id", slot)
        .join(products.select("product_id", F.col("unit_price").alias("list_price")), "product_id")
        .select(
            ((order_id - 1) * 4 + line).alias("order_item_id"),
            "order_id",
            "product_id",
            ((order_id + line) % 4 + 1).cast("int").alias("quantity"),
            F.round(price, 2).cast("decimal(10,2)").alias("unit_price"),
            "discount_pct",
        )
    )


def gen_model(
    spark: SparkSession, customers: int = CUSTOMERS, orders: int = ORDERS
) -> RetailModel:
    """All six tables; the defaults give the standard data set."""
    products = gen_products(spark)
    headers = gen_orders(sequence(spark, orders), customers)
    return RetailModel(
        regions=gen_regions(spark),
        categories=gen_categories(spark),
        customers=reclassify_platinum(gen_customers(sequence(spark, customers))),
        products=products,
        orders=headers,
        order_items=gen_order_items(headers, products),
    )
