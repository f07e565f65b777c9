"""Reading and writing the six tables, with layouts for large data.

Two layouts take the place of secondary indexes:

* ``write_tables``: plain Parquet. Orders are partitioned by status and sorted
  by date inside each file, so a status filter prunes folders and a date range
  prunes row groups. Lines are range-clustered by order, so that the sum per
  order is complete after the map-side combine. The range key includes the line,
  which lets an order with very many lines spread over several files.
* ``save_bucketed``: orders, and the lines folded per order, bucketed alike by
  order_id. Joining them needs no exchange at all. A bucket holds a row per
  order, so no order can outweigh it; the lines themselves are clustered as above.

``store_order_totals`` keeps the lines folded per order. Every report at order
grain or above then reads that table, several times smaller than the lines.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillscope.model import RetailModel
from tillscope.schema import SCHEMAS, TABLES

Schemas = Mapping[str, StructType]
Watch = Callable[[str, DataFrame], DataFrame]


def declared(model: RetailModel, table: str, schemas: Schemas) -> DataFrame:
    """The table's declared columns in their declared types."""
    return model.table(table).select(
        *[F.col(field.name).cast(field.dataType).alias(field.name) for field in schemas[table]]
    )


def write_tables(
    model: RetailModel, root: str, schemas: Schemas = SCHEMAS, watch: Watch | None = None
) -> None:
    """Overwrite ``root``/<table> with the six tables.

    ``watch`` may add to what is written, such as ``observe`` metrics (see ``operators.quarantine.watched``).
    """
    for table in TABLES:
        frame = declared(model, table, schemas)
        if table == "orders":
            frame = frame.sortWithinPartitions("status", "order_date")
            frame = frame if watch is None else watch(table, frame)
            frame.write.mode("overwrite").partitionBy("status").parquet(f"{root}/{table}")
            continue
        if table == "order_items":
            frame = frame.repartitionByRange("order_id", "order_item_id").sortWithinPartitions(
                "order_id", "order_item_id"
            )
        # Behind the exchange, since its sampling reads the rows once more.
        frame = frame if watch is None else watch(table, frame)
        frame.write.mode("overwrite").parquet(f"{root}/{table}")


def read_tables(spark: SparkSession, root: str, schemas: Schemas = SCHEMAS) -> RetailModel:
    """Scan the six tables with their declared schemas; nothing is inferred."""
    return RetailModel(
        **{
            table: spark.read.schema(schemas[table])
            .parquet(f"{root}/{table}")
            .select(*schemas[table].names)
            for table in TABLES
        }
    )


def save_bucketed(
    model: RetailModel, database: str, buckets: int, schemas: Schemas = SCHEMAS
) -> None:
    """Save the tables to a catalog database, orders and order totals bucketed by order_id.

    Choose ``buckets`` so that one bucket of orders is a few hundred MB.
    """

    def save(writer: DataFrameWriter, table: str) -> None:
        writer.mode("overwrite").format("parquet").saveAsTable(f"{database}.{table}")

    def in_buckets(frame: DataFrame) -> DataFrameWriter:
        writer = frame.repartition(buckets, "order_id").write
        return writer.bucketBy(buckets, "order_id").sortBy("order_id")

    for table in TABLES:
        frame = declared(model, table, schemas)
        if table == "order_items":
            frame = frame.repartitionByRange("order_id", "order_item_id")
        save(in_buckets(frame) if table == "orders" else frame.write, table)
    save(in_buckets(model.order_totals), "order_totals")


def open_tables(spark: SparkSession, database: str) -> RetailModel:
    """The model saved by ``save_bucketed``; its reports read the stored order totals."""
    stored = {table: spark.table(f"{database}.{table}") for table in (*TABLES, "order_totals")}
    return RetailModel(**stored)


def store_order_totals(model: RetailModel, path: str) -> RetailModel:
    """Write the lines folded per order; the returned model's reports read that table."""
    totals = model.order_totals
    totals.write.mode("overwrite").parquet(path)
    stored = totals.sparkSession.read.schema(totals.schema).parquet(path)
    return model.with_tables(order_totals=stored)
