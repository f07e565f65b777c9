"""Declared constraints as validation jobs: Parquet enforces none of them.

Each job returns one row per rule with its number of violations. Keys and
references are counted per value before anything is compared, so a value that
fills a third of a table is one row after the map-side combine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.model import RetailModel
from tillscope.schema import (
    DEFAULTS,
    FOREIGN_KEYS,
    PRIMARY_KEYS,
    SEGMENTS,
    STATUSES,
    TABLES,
    UNIQUE_COLUMNS,
    check_rules,
    required_columns,
)


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _zero_if_null(column) -> F.Column:
    return F.coalesce(column, F.lit(0).cast("bigint"))


def key_counts(model: RetailModel, table: str, column: str) -> DataFrame:
    """key, rows: how often each value of a column occurs, NULL included."""
    return model.table(table).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("rows"))


def duplicate_keys(model: RetailModel, table: str, column: str) -> DataFrame:
    """The non-null values of a column that occur more than once."""
    return key_counts(model, table, column).filter(F.col("key").isNotNull() & (F.col("rows") > 1))


def orphans(model: RetailModel, child: str, column: str, parent: str) -> DataFrame:
    """Non-null references without a parent row, with the number of rows that hold them."""
    parents = model.table(parent).select(F.col(PRIMARY_KEYS[parent]).alias("key"))
    references = key_counts(model, child, column).filter(F.col("key").isNotNull())
    return references.join(parents, "key", "left_anti")


def _uniqueness(model: RetailModel, table: str, column: str) -> DataFrame:
    repeated = F.col("key").isNotNull() & (F.col("rows") > 1)
    return (
        key_counts(model, table, column)
        .agg(
            _zero_if_null(F.sum(F.when(F.col("key").isNull(), F.col("rows")))).alias("null_rows"),
            F.count(F.when(repeated, 1)).alias("duplicate_keys"),
            _zero_if_null(F.sum(F.when(repeated, F.col("rows") - 1))).alias("surplus_rows"),
        )
        .select(
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            "null_rows",
            "duplicate_keys",
            "surplus_rows",
        )
    )


def q_pk(model: RetailModel) -> DataFrame:
    """Primary keys: NULL rows, values used more than once, rows beyond the first."""
    return _stack([_uniqueness(model, table, key) for table, key in PRIMARY_KEYS.items()])


def q_uniq(model: RetailModel) -> DataFrame:
    """Unique columns; NULL is allowed any number of times."""
    return _stack(
        [_uniqueness(model, table, column).drop("null_rows") for table, column in UNIQUE_COLUMNS]
    )


def q_fk(model: RetailModel) -> DataFrame:
    """References: distinct dangling values and the rows that hold them."""
    return _stack(
        [
            orphans(model, child, column, parent)
            .agg(
                F.count("*").alias("orphan_keys"),
                _zero_if_null(F.sum("rows")).alias("orphan_rows"),
            )
            .select(
                F.lit(child).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.lit(parent).alias("parent_table"),
                "orphan_keys",
                "orphan_rows",
            )
            for child, column, parent in FOREIGN_KEYS
        ]
    )


def q_check(
    model: RetailModel,
    segments: tuple[str, ...] = SEGMENTS,
    statuses: tuple[str, ...] = STATUSES,
) -> DataFrame:
    """Rows that make a CHECK false; an unknown (NULL) outcome passes."""
    return _stack(
        [
            model.table(table)
            .agg(F.count_if(~condition).alias("violations"))
            .select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations")
            for table, rule, condition in check_rules(segments, statuses)
        ]
    )


def _null_counts(model: RetailModel, table: str, columns: list[str], name: str) -> DataFrame:
    """One pass over a table: NULLs per column, one row per column."""
    counted = model.table(table).agg(
        F.lit(table).alias("table_name"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counted.unpivot("table_name", columns, "column_name", name)


def q_nn(model: RetailModel) -> DataFrame:
    """NULLs in columns declared NOT NULL."""
    return _stack(
        [_null_counts(model, table, required_columns(table), "null_rows") for table in TABLES]
    )


def q_def(model: RetailModel) -> DataFrame:
    """Values that the declared defaults would fill in, per column."""
    return _stack(
        [
            _null_counts(model, table, list(columns), "filled_rows")
            for table, columns in DEFAULTS.items()
        ]
    )
