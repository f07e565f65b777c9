"""The star model every operator works on."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.measures import Sales, counted, gross_micros, line_sums, net_micros
from tillscope.functions.skew import dealt_join, hot_keys
from tillscope.schema import TABLES

Table = DataFrame | Callable[[], DataFrame]


class RetailModel:
    """Six DataFrames: regions, categories, customers, products, orders, order_items.

    A table may be given as a function; it is then built on first use, so an
    analysis only plans the tables it reads. ``order_items`` may carry exact
    ``gross_micros`` and ``net_micros`` of its own, for sources that store line
    amounts instead of unit prices. ``order_totals`` may be a stored copy of the
    frame of that name (see ``sources.tables.store_order_totals``).

    ``line_keys`` are the columns that lines share with their order: its id, and in
    a layout by folders those of the folder, so that the lines' folders are pruned too.
    """

    line_keys: tuple[str, ...] = ("order_id",)

    def __init__(
        self,
        regions: Table,
        categories: Table,
        customers: Table,
        products: Table,
        orders: Table,
        order_items: Table,
        order_totals: Table | None = None,
    ) -> None:
        self._tables = {
            "regions": regions,
            "categories": categories,
            "customers": customers,
            "products": products,
            "orders": orders,
            "order_items": order_items,
            "order_totals": self._fold_lines if order_totals is None else order_totals,
        }
        self.totals_stored = order_totals is not None
        #: Values of order_id and product_id that joins of lines deal out to many tasks.
        self.hot: dict[str, list] = {}

    def table(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def with_tables(self, **tables: Table) -> "RetailModel":
        """A model with some tables replaced; totals are folded anew from replaced lines."""
        kept = {name: self._tables[name] for name in TABLES}
        if self.totals_stored and "order_items" not in tables:
            kept["order_totals"] = self._tables["order_totals"]
        return RetailModel(**{**kept, **tables})

    def dealing_hot_keys(self, share: float = 0.01) -> "RetailModel":
        """The same model; joins of its lines deal out the orders and products that are hot.

        A key is hot from that share of all lines on. Two passes over a column of the lines
        find them (see ``functions.skew``), when this is called.
        """
        model = copy(self)
        columns = ("order_id", "product_id")
        model.hot = {c: hot_keys(self.order_items.select(c), c, share) for c in columns}
        return model

    def join_lines(
        self, lines: DataFrame, other: DataFrame, column: str, how: str = "inner"
    ) -> DataFrame:
        """Lines joined with their orders or products, one row for each value of ``column``."""
        keys = list(self.line_keys) if column == "order_id" else [column]
        keys = [key for key in keys if key in lines.columns and key in other.columns]
        ways = 8 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return dealt_join(lines, other, keys, column, self.hot.get(column, []), how, ways)

    @property
    def regions(self) -> DataFrame:
        return self.table("regions")

    @property
    def categories(self) -> DataFrame:
        return self.table("categories")

    @property
    def customers(self) -> DataFrame:
        return self.table("customers")

    @property
    def products(self) -> DataFrame:
        return self.table("products")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def order_items(self) -> DataFrame:
        return self.table("order_items")

    def kept_orders(self, sales: Sales, since: Column | None = None) -> DataFrame:
        """Orders counted by ``sales``, from the date ``since`` on."""
        return self._filtered(self.orders, sales, since)

    @staticmethod
    def _filtered(orders: DataFrame, sales: Sales, since: Column | None) -> DataFrame:
        kept = orders.filter(counted(sales))
        return kept if since is None else kept.filter(F.col("order_date") >= since)

    @property
    def lines(self) -> DataFrame:
        """Order items with line amounts: gross, and net of the line discount."""
        return self._with_amounts(self.order_items)

    @staticmethod
    def _with_amounts(items: DataFrame) -> DataFrame:
        if "gross_micros" not in items.columns:
            items = items.withColumn("gross_micros", gross_micros("quantity", "unit_price"))
        if "net_micros" not in items.columns:
            items = items.withColumn("net_micros", net_micros("gross_micros", "discount_pct"))
        return items

    def _fold_lines(self) -> DataFrame:
        return self.lines.groupBy("order_id").agg(
            F.count("*").alias("lines"),
            F.sum("quantity").alias("units"),
            *line_sums("gross", "net"),
        )

    @property
    def order_totals(self) -> DataFrame:
        """One row per order that has lines: lines, units, partial sums of gross and net."""
        return self.table("order_totals")

    @property
    def keyed_lines(self) -> DataFrame:
        """Lines with all columns of ``line_keys``."""
        return self.lines

    @property
    def keyed_totals(self) -> DataFrame:
        """Order totals with all columns of ``line_keys``."""
        return self.order_totals

    @property
    def month_sums(self) -> DataFrame | None:
        """Stored sums per month and status, where a layout keeps them."""
        return None

    @property
    def named_customers(self) -> DataFrame:
        """Customers with ``customer_name``; NULL if either part is missing."""
        return self.customers.withColumn(
            "customer_name", F.concat("first_name", F.lit(" "), "last_name")
        )

    @property
    def catalogue(self) -> DataFrame:
        """Products with ``category_name`` and ``root_name``.

        The root is the category's parent, or the category itself if it has none;
        it climbs one level only.
        """
        parents = self.categories.select(
            F.col("category_id").alias("parent_id"), F.col("category_name").alias("parent_name")
        )
        categories = self.categories.join(parents, "parent_id", "left").select(
            "category_id",
            "category_name",
            F.coalesce("parent_name", "category_name").alias("root_name"),
        )
        return self.products.join(categories, "category_id")
