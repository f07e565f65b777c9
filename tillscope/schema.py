"""Explicit schemas and declared rules of the six retail tables.

Nothing is ever inferred from files: a scan starts with the types below. The
rules (keys, references, checks, defaults) are data, so that the validation
jobs in ``operators.quality`` can walk over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRICE = T.DecimalType(10, 2)
_PERCENT = T.DecimalType(5, 2)


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


SCHEMAS: dict[str, T.StructType] = {
    "regions": _table(
        ("region_id", T.LongType(), False),
        ("region_name", T.StringType(), False),
        ("country", T.StringType(), False),
    ),
    "categories": _table(
        ("category_id", T.LongType(), False),
        ("category_name", T.StringType(), False),
        ("parent_id", T.LongType(), True),
        ("is_active", T.BooleanType(), False),
    ),
    "customers": _table(
        ("customer_id", T.LongType(), False),
        ("first_name", T.StringType(), False),
        ("last_name", T.StringType(), False),
        ("email", T.StringType(), False),
        ("phone", T.StringType(), True),
        ("region_id", T.LongType(), False),
        ("segment", T.StringType(), False),
        ("date_joined", T.DateType(), False),
        ("is_active", T.BooleanType(), False),
    ),
    "products": _table(
        ("product_id", T.LongType(), False),
        ("product_name", T.StringType(), False),
        ("category_id", T.LongType(), False),
        ("unit_cost", _PRICE, False),
        ("unit_price", _PRICE, False),
        ("stock_qty", T.IntegerType(), False),
        ("is_active", T.BooleanType(), False),
    ),
    "orders": _table(
        ("order_id", T.LongType(), False),
        ("customer_id", T.LongType(), False),
        ("order_date", T.DateType(), False),
        ("shipped_date", T.DateType(), True),
        ("status", T.StringType(), False),
        ("payment_method", T.StringType(), False),
        ("discount_pct", _PERCENT, False),
    ),
    "order_items": _table(
        ("order_item_id", T.LongType(), False),
        ("order_id", T.LongType(), False),
        ("product_id", T.LongType(), False),
        ("quantity", T.IntegerType(), False),
        ("unit_price", _PRICE, False),
        ("discount_pct", _PERCENT, False),
    ),
}

TABLES = tuple(SCHEMAS)

# The closed vocabularies of the data model.
SEGMENTS = ("Bronze", "Silver", "Gold", "Platinum")
STATUSES = ("Pending", "Processing", "Shipped", "Delivered", "Cancelled", "Returned")
VOID_STATUSES = ("Cancelled", "Returned")
DEFAULT_COUNTRY = "United States"

PRIMARY_KEYS: dict[str, str] = {
    "regions": "region_id",
    "categories": "category_id",
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
}

UNIQUE_COLUMNS: tuple[tuple[str, str], ...] = (
    ("regions", "region_name"),
    ("customers", "email"),
)

# child table, child column, parent table (referenced by its primary key)
FOREIGN_KEYS: tuple[tuple[str, str, str], ...] = (
    ("categories", "parent_id", "categories"),
    ("customers", "region_id", "regions"),
    ("products", "category_id", "categories"),
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
)

DEFAULTS: dict[str, dict[str, object]] = {
    "regions": {"country": DEFAULT_COUNTRY},
    "categories": {"is_active": True},
    "customers": {"is_active": True},
    "products": {"stock_qty": 0, "is_active": True},
    "orders": {"discount_pct": 0},
    "order_items": {"discount_pct": 0},
}


def check_rules(
    segments: tuple[str, ...] = SEGMENTS, statuses: tuple[str, ...] = STATUSES
) -> tuple[tuple[str, str, Column], ...]:
    """(table, rule, condition that a row must not make false) for every CHECK."""
    return (
        ("customers", "segment in domain", F.col("segment").isin(*segments)),
        ("orders", "status in domain", F.col("status").isin(*statuses)),
        ("order_items", "quantity positive", F.col("quantity") > 0),
    )


def required_columns(table: str) -> list[str]:
    return [field.name for field in SCHEMAS[table].fields if not field.nullable]
