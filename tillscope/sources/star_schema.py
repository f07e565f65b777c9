"""Adapter: an order/line star schema (region, nation, customer, part, orders,
lineitem) as the retail model.

Columns the source lacks are derived from ones it has, by fixed rules, or left
NULL for the declared defaults to fill. Line amounts become whole numbers on
entry; the source's price per unit is not exact, its line amount is.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.measures import Sales, from_cents, rounded_div
from tillscope.model import RetailModel
from tillscope.schema import SCHEMAS
from tillscope.sources.defaults import with_defaults

# The day after the last order; stands in for today.
AS_OF = date(2001, 8, 2)

_SCANS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _retyped(table: str, **kinds: T.DataType) -> T.StructType:
    """The declared schema of a table with columns of another type, or more columns."""
    fields = {field.name: field for field in SCHEMAS[table]}
    return T.StructType(
        list((fields | {name: T.StructField(name, kind) for name, kind in kinds.items()}).values())
    )


# For storing this model with ``sources.tables``: category ids are text here, line
# ids hold an order and a line number, and line amounts are kept because the price
# per unit is rounded.
STORED_SCHEMAS = SCHEMAS | {
    "categories": _retyped("categories", category_id=T.StringType(), parent_id=T.StringType()),
    "products": _retyped("products", category_id=T.StringType()),
    "order_items": _retyped(
        "order_items",
        order_item_id=T.DecimalType(29, 0),
        gross_micros=T.LongType(),
        net_micros=T.LongType(),
    ),
}

_LINE_NUMBERS = 2**32  # as many as the line number's type has


def _unknown(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _regions(region: DataFrame) -> DataFrame:
    return region.select(
        F.col("r_regionkey").cast("bigint").alias("region_id"),
        F.col("r_name").alias("region_name"),
        _unknown("string").alias("country"),
    )


def _categories(part: DataFrame) -> DataFrame:
    """One root per part type, one leaf per type and brand."""
    root = F.struct(
        F.col("p_type").alias("category_id"),
        F.col("p_type").alias("category_name"),
        _unknown("string").alias("parent_id"),
        (F.col("p_type") != "PROMO").alias("is_active"),
    )
    leaf = F.struct(
        F.concat("p_type", F.lit("/"), "p_brand").alias("category_id"),
        F.col("p_brand").alias("category_name"),
        F.col("p_type").alias("parent_id"),
        _unknown("boolean").alias("is_active"),
    )
    pairs = part.select("p_type", "p_brand").distinct()
    return pairs.select(F.explode(F.array(root, leaf)).alias("row")).select("row.*").distinct()


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    homes = nation.select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.col("n_regionkey").cast("bigint").alias("region_id"),
    )
    joined_after = (F.col("c_custkey") % 1826).cast("int")
    return customer.join(homes, "c_nationkey", "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.substring_index("c_name", "#", 1).alias("first_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.concat(F.lit("customer"), "c_custkey", F.lit("@example.com")).alias("email"),
        _unknown("string").alias("phone"),
        "region_id",
        F.col("c_mktsegment").alias("segment"),
        F.date_add(F.lit(date(1995, 1, 1)), joined_after).alias("date_joined"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def _products(part: DataFrame, *more: Column) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(10,2)")
    cost_share = F.lit("0.500").cast("decimal(4,3)") + F.col("p_size").cast(
        "decimal(3,0)"
    ) * F.lit("0.005").cast("decimal(4,3)")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat("p_type", F.lit("/"), "p_brand").alias("category_id"),
        F.round(price * cost_share, 2).cast("decimal(10,2)").alias("unit_cost"),
        price.alias("unit_price"),
        _unknown("int").alias("stock_qty"),
        (F.col("p_size") >= 5).alias("is_active"),
        *more,
    )


def _orders(orders: DataFrame) -> DataFrame:
    source = F.col("o_orderstatus")
    status = (  # a code that isn't known stays, for the rules to see
        F.when(source == "F", "Delivered")
        .when(source == "O", "Shipped")
        .when(source == "P", "Cancelled")
        .otherwise(source)
    )
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        _unknown("date").alias("shipped_date"),
        status.alias("status"),
        F.col("o_orderpriority").alias("payment_method"),
        _unknown("decimal(5,2)").alias("discount_pct"),
    )


def _whole(value: str, per: int) -> Column:
    """A double with few decimals as a whole number of 1/per units, exactly."""
    return F.rint(F.col(value) * per).cast("bigint")


def _order_items(lineitem: DataFrame) -> DataFrame:
    cents = _whole("l_extendedprice", 100)
    basis_points = _whole("l_discount", 10_000)
    quantity = F.col("l_quantity").cast("bigint")
    first_of_order = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(_LINE_NUMBERS)
    return lineitem.select(
        (first_of_order + F.col("l_linenumber")).cast("decimal(29,0)").alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        quantity.alias("quantity"),
        from_cents(rounded_div(cents, F.nullif(quantity, F.lit(0)))).alias("unit_price"),
        from_cents(basis_points).cast("decimal(5,2)").alias("discount_pct"),
        (cents * 10_000).alias("gross_micros"),
        (cents * (10_000 - basis_points)).alias("net_micros"),
    )


# Source codes of the states that an analysis counts.
_COUNTED = {Sales.VALID: ("F", "O"), Sales.DELIVERED: ("F",)}


class StarSchema(RetailModel):
    """The model over ``root``/<table>.parquet.

    With ``fill`` off, columns unknown to the source stay NULL.
    """

    def __init__(self, spark: SparkSession, root: str, fill: bool = True) -> None:
        def read(table: str) -> DataFrame:
            return spark.read.schema(_SCANS[table]).parquet(f"{root}/{table}.parquet")

        def finish(table: str, frame: DataFrame) -> DataFrame:
            return with_defaults(table, frame) if fill else frame

        self._read = read
        self._finish = finish
        super().__init__(
            regions=lambda: finish("regions", _regions(read("region"))),
            categories=lambda: finish("categories", _categories(read("part"))),
            customers=lambda: finish("customers", _customers(read("customer"), read("nation"))),
            products=lambda: finish("products", _products(read("part"))),
            orders=lambda: finish("orders", _orders(read("orders"))),
            order_items=lambda: finish("order_items", _order_items(read("lineitem"))),
        )

    @property
    def catalogue(self) -> DataFrame:
        """The source's parts carry both category names, so nothing has to be joined."""
        names = F.col("p_brand").alias("category_name"), F.col("p_type").alias("root_name")
        return self._finish("products", _products(self._read("part"), *names))

    def kept_orders(self, sales: Sales, since: Column | None = None) -> DataFrame:
        """Filters on the source's own columns, so that they reach the scan."""
        source = self._read("orders")
        if sales is not Sales.ANY:
            source = source.filter(F.col("o_orderstatus").isin(*_COUNTED[sales]))
        if since is not None:
            source = source.filter(F.col("o_orderdate") >= since.cast("timestamp_ntz"))
        return self._finish("orders", _orders(source))
