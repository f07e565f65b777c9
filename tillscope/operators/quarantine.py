"""Rows that break declared rules, with the rules they break, and all row rules in one scan.

``operators.quality`` counts; here the rows themselves are split off. Rules of a
single row are conditions in the scan. Rules between rows (keys, references)
become lists of bad values first: values are counted before anything is joined
back, so a value that fills a third of a table is one row of such a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tillscope.model import RetailModel
from tillscope.operators.quality import duplicate_keys, orphans
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
from tillscope.session import durable

#: Bad values that every task may hold, at most; more are joined by a shuffle.
MOST_LISTED = 100_000


def _row_rules(
    table: str, segments: tuple[str, ...], statuses: tuple[str, ...]
) -> list[tuple[str, Column]]:
    """(rule, condition that holds where a row breaks it) for NOT NULL and CHECK."""
    rules = [(f"{c} is NULL", F.col(c).isNull()) for c in required_columns(table)]
    rules += [
        (rule, ~condition)
        for of_table, rule, condition in check_rules(segments, statuses)
        if of_table == table
    ]
    return rules


def _bad_values(model: RetailModel, table: str) -> list[tuple[str, str, DataFrame]]:
    """(rule, column, its values that break the rule) for keys and references."""
    unique = [(table, PRIMARY_KEYS[table]), *UNIQUE_COLUMNS]
    found = [
        (f"{column} repeated", column, duplicate_keys(model, table, column))
        for of_table, column in unique
        if of_table == table
    ]
    return found + [
        (f"{column} not in {parent}", column, orphans(model, table, column, parent))
        for child, column, parent in FOREIGN_KEYS
        if child == table
    ]


def with_broken_rules(
    model: RetailModel,
    table: str,
    segments: tuple[str, ...] = SEGMENTS,
    statuses: tuple[str, ...] = STATUSES,
) -> DataFrame:
    """The table's rows with ``broken``, the rules each one breaks, in the order of declaration.

    Every row that holds a repeated key breaks its rule, since none of them is known
    to be the right one. A NULL key or reference breaks NOT NULL only. The table
    moves for a key or reference only if it has more bad values than every task may
    hold. Runs jobs when called.
    """
    rows = model.table(table)
    conditions = []
    for place, (rule, column, bad) in enumerate(_bad_values(model, table)):
        values = durable(bad.select(F.col("key").alias(column), F.lit(True).alias(f"_bad{place}")))
        size = values.count()
        if size:
            listed = F.broadcast(values) if size <= MOST_LISTED else values
            rows = rows.join(listed, column, "left")
            conditions.append((rule, F.col(f"_bad{place}")))
    conditions += _row_rules(table, segments, statuses)
    broken = F.array_compact(F.array(*[F.when(wrong, F.lit(rule)) for rule, wrong in conditions]))
    return rows.select(*model.table(table).columns, broken.alias("broken"))


def split(
    model: RetailModel,
    table: str,
    segments: tuple[str, ...] = SEGMENTS,
    statuses: tuple[str, ...] = STATUSES,
) -> tuple[DataFrame, DataFrame]:
    """(sound rows, faulty rows with ``broken``): a quarantine of one table."""
    judged = with_broken_rules(model, table, segments, statuses)
    faulty = F.size("broken") > 0
    return judged.where(~faulty).drop("broken"), judged.where(faulty)


def q_violations(
    model: RetailModel,
    segments: tuple[str, ...] = SEGMENTS,
    statuses: tuple[str, ...] = STATUSES,
) -> DataFrame:
    """Every faulty row of every table: its table, its key and the rules it breaks."""
    parts = [
        split(model, table, segments, statuses)[1].select(
            F.lit(table).alias("table_name"),
            F.col(key).cast("string").alias("row_key"),
            F.array_join("broken", "; ").alias("rules"),
        )
        for table, key in PRIMARY_KEYS.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def _measures(
    table: str, segments: tuple[str, ...], statuses: tuple[str, ...]
) -> dict[tuple[str, str], Column]:
    """(kind, name) -> count, of everything a single pass over the table can tell."""
    found = {("rows", ""): F.count("*")}
    found |= {("null", c): F.count_if(F.col(c).isNull()) for c in required_columns(table)}
    found |= {("default", c): F.count_if(F.col(c).isNull()) for c in DEFAULTS[table]}
    found |= {
        ("check", rule): F.count_if(~condition)
        for of_table, rule, condition in check_rules(segments, statuses)
        if of_table == table
    }
    return found


def q_scan(
    model: RetailModel,
    segments: tuple[str, ...] = SEGMENTS,
    statuses: tuple[str, ...] = STATUSES,
) -> DataFrame:
    """Row counts, NULLs, values to fill in and failed checks of all tables, a scan for each table."""

    def scanned(table: str) -> DataFrame:
        measures = _measures(table, segments, statuses)
        counts = model.table(table).agg(*[c.alias(f"m{i}") for i, c in enumerate(measures.values())])
        listed = [
            F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(f"m{i}").alias("rows"))
            for i, (kind, name) in enumerate(measures)
        ]
        rows = counts.select(F.explode(F.array(*listed)).alias("row"))
        return rows.select(F.lit(table).alias("table_name"), "row.*")

    return reduce(DataFrame.unionAll, [scanned(table) for table in TABLES])


def observed(
    frame: DataFrame,
    table: str,
    segments: tuple[str, ...] = SEGMENTS,
    statuses: tuple[str, ...] = STATUSES,
) -> tuple[DataFrame, Observation]:
    """The frame, and what ``q_scan`` counts of it while an action such as a write runs over it."""
    watch = Observation(f"rules of {table}")
    measures = _measures(table, segments, statuses)
    columns = [c.alias(f"{kind}:{name}") for (kind, name), c in measures.items()]
    return frame.observe(watch, *columns), watch


def watched(found: dict[str, Observation], **domains: tuple[str, ...]):
    """For ``write_tables``: observes each table as it is written, no scan more; see ``found``."""

    def watch(table: str, frame: DataFrame) -> DataFrame:
        frame, found[table] = observed(frame, table, **domains)
        return frame

    return watch
