"""Orders and lines by month and status, with totals that are kept up to date month by month.

``root``/<table>/order_month=<first day>/status=<status> holds orders, their lines,
the lines folded per order, and the sums of each month and status. An
analysis of some months or states lists the folders it needs and opens no
other; lines are pruned too, since they carry both columns of their order.

A month is the unit of change. ``replace_months`` writes the folders of the given
months anew, from the orders and lines as they are now, and then brings the totals of
these months up to date from the lines just written. Sums are whole numbers, so months
added up give what a rebuild gives. Every step overwrites, so a retry after
a failure anywhere ends in the same tables. An order that changes its month
changes two of them.

Orders need a date and a status (both are NOT NULL; ``operators.quarantine`` splits
off others). Lines without an order are kept in the month called ``unknown``.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.measures import Sales, carried_sums, line_sums, month_of
from tillscope.model import RetailModel
from tillscope.schema import SCHEMAS
from tillscope.sources.tables import Schemas, declared

UNKNOWN = "unknown"
FOLDERS = ("order_month", "status")
PLAIN = ("regions", "categories", "customers", "products")
_TOTALS = ("gross_high", "gross_low", "net_high", "net_low")


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.LongType()) for name in names]


def _schemas(schemas: Schemas) -> dict[str, T.StructType]:
    """The stored columns of the four tables by month, folders included."""
    month = T.StructField("order_month", T.StringType())
    status = T.StructField("status", T.StringType())
    orders = [f for f in schemas["orders"] if f.name != "status"]
    return {
        "orders": T.StructType([*orders, month, status]),
        "order_items": T.StructType([*schemas["order_items"], month, status]),
        "order_totals": T.StructType([*_longs("order_id", "lines", "units", *_TOTALS), month, status]),
        "month_sums": T.StructType([*_longs("orders", "lines", "units", *_TOTALS), month, status]),
    }


def _placed(model: RetailModel, schemas: Schemas, months: list[str] | None) -> dict[str, DataFrame]:
    """Orders and lines with their folder, of some months or all."""
    orders = declared(model, "orders", schemas).withColumn(
        "order_month", month_of("order_date").cast("string")
    )
    wanted = F.lit(True) if months is None else F.col("order_month").isin(*months)
    orders = orders.where(wanted)
    lines = declared(model, "order_items", schemas)
    folders = orders.select("order_id", *FOLDERS)
    # Without a month there are lines of no order only if all orders are at hand.
    lines = lines.join(folders, "order_id", "left" if months is None else "inner")
    unknown = {c: F.coalesce(c, F.lit(UNKNOWN)) for c in FOLDERS}
    return {"orders": orders, "order_items": lines.withColumns(unknown)}


def _clustered(frame: DataFrame, *keys: str) -> DataFrame:
    """A folder's rows in few files: ranges of folder and key, so a hot month has many tasks."""
    order = [*FOLDERS, *keys]
    return frame.repartitionByRange(*order).sortWithinPartitions(*order)


def _write(frame: DataFrame, table: str, root: str, months: list[str] | None) -> None:
    """All of a table, or the folders of some months: also those that hold nothing any more."""
    if months is None:
        frame.write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{root}/{table}")
        return
    for month in months:
        part = frame.where(F.col("order_month") == month).drop("order_month")
        part.write.mode("overwrite").partitionBy("status").parquet(
            f"{root}/{table}/order_month={month}"
        )


def _names(months: Iterable[date] | None) -> list[str] | None:
    return None if months is None else sorted({m.replace(day=1).isoformat() for m in months})


def _refresh(spark: SparkSession, root: str, months: list[str] | None, schemas: Schemas) -> None:
    """Order totals and month sums of the months, from their stored lines."""
    stored = MonthlyTables(spark, root, schemas)
    lines = stored.keyed_lines.where(F.col("order_month") != UNKNOWN)
    if months is not None:
        lines = lines.where(F.col("order_month").isin(*months))
    totals = lines.groupBy(*FOLDERS, "order_id").agg(
        F.count("*").alias("lines"),
        F.sum("quantity").cast("bigint").alias("units"),
        *line_sums("gross", "net"),
    )
    _write(_clustered(totals, "order_id"), "order_totals", root, months)
    totals = MonthlyTables(spark, root, schemas).keyed_totals
    if months is not None:
        totals = totals.where(F.col("order_month").isin(*months))
    sums = totals.groupBy(*FOLDERS).agg(
        F.count("*").alias("orders"),
        F.sum("lines").alias("lines"),
        F.sum("units").alias("units"),
        *carried_sums("gross", "net"),
    )
    _write(sums, "month_sums", root, months)


def write_months(model: RetailModel, root: str, schemas: Schemas = SCHEMAS) -> None:
    """Overwrite ``root`` with the model by month and status, totals included."""
    for table in PLAIN:
        declared(model, table, schemas).write.mode("overwrite").parquet(f"{root}/{table}")
    placed = _placed(model, schemas, None)
    _write(_clustered(placed["orders"], "order_date"), "orders", root, None)
    _write(_clustered(placed["order_items"], "order_id", "order_item_id"), "order_items", root, None)
    _refresh(model.orders.sparkSession, root, None, schemas)


def replace_months(
    model: RetailModel, root: str, months: Iterable[date], schemas: Schemas = SCHEMAS
) -> None:
    """Write the months' folders anew and refresh their totals; all other folders stay untouched.

    ``model`` is the source as it is now, after changed, late or removed orders and lines.
    """
    names = _names(months)
    placed = _placed(model, schemas, names)
    _write(_clustered(placed["orders"], "order_date"), "orders", root, names)
    _write(_clustered(placed["order_items"], "order_id", "order_item_id"), "order_items", root, names)
    _refresh(model.orders.sparkSession, root, names, schemas)


class MonthlyTables(RetailModel):
    """The model stored by ``write_months``; reports read its totals where they suffice.

    ``months`` restricts orders, lines and totals to some months.
    """

    line_keys = ("order_id", *FOLDERS)

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schemas: Schemas = SCHEMAS,
        months: Iterable[date] | None = None,
    ) -> None:
        kinds = schemas | _schemas(schemas)
        wanted = _names(months)

        def read(table: str) -> DataFrame:
            frame = spark.read.schema(kinds[table]).parquet(f"{root}/{table}")
            if wanted is not None and "order_month" in frame.columns:
                frame = frame.where(F.col("order_month").isin(*wanted))
            return frame

        self._read = read
        super().__init__(
            **{table: (lambda t=table: read(t).select(*schemas[t].names)) for table in schemas},
            order_totals=lambda: read("order_totals").drop(*FOLDERS),
        )

    def kept_orders(self, sales: Sales, since: Column | None = None) -> DataFrame:
        """With the folder's month; from a date on, earlier months aren't opened."""
        orders = self._filtered(self._read("orders"), sales, since)
        if since is None:
            return orders
        return orders.where(F.col("order_month") >= month_of(since).cast("string"))

    @property
    def keyed_lines(self) -> DataFrame:
        return self._with_amounts(self._read("order_items"))

    @property
    def keyed_totals(self) -> DataFrame:
        return self._read("order_totals")

    @property
    def month_sums(self) -> DataFrame:
        """One row per month and status: orders, lines, units, partial sums of gross and net."""
        return self._read("month_sums").withColumn("sales_month", F.col("order_month").cast("date"))
