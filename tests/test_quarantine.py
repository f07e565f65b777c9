"""Faulty rows with their reasons, and all row rules in one scan."""

from collections import Counter

import pytest

from test_quality import broken  # noqa: F401
from tillscope.operators import quality, quarantine
from tillscope.schema import PRIMARY_KEYS, TABLES
from tillscope.sources.tables import write_tables


def faults(model, table):
    sound, faulty = quarantine.split(model, table)
    assert sound.columns == model.table(table).columns
    rows = faulty.collect()
    assert sound.count() + len(rows) == model.table(table).count()
    return rows


@pytest.mark.parametrize("listed", [0, 100_000])
def test_rows_come_back_with_every_rule_they_break(broken, monkeypatch, listed):  # noqa: F811
    """By a list in every task and by a shuffle."""
    monkeypatch.setattr(quarantine, "MOST_LISTED", listed)
    found = sorted((r.customer_id, r.broken) for r in faults(broken, "customers"))
    assert found == [
        (1, ["email repeated", "is_active is NULL"]),
        (2, ["email repeated", "region_id not in regions", "segment in domain"]),
        (3, ["region_id not in regions", "email is NULL", "segment is NULL"]),
        (4, ["email is NULL"]),
    ]
    found = sorted((r.order_id or 0, r.broken) for r in faults(broken, "orders"))
    assert found == [
        (0, ["order_id is NULL", "customer_id is NULL", "status is NULL", "discount_pct is NULL"]),
        (1, ["order_id repeated", "customer_id not in customers", "order_date is NULL", "discount_pct is NULL",
             "status in domain"]),
        (1, ["order_id repeated", "discount_pct is NULL"]),
    ]


def test_rows_agree_with_the_counts(broken):  # noqa: F811
    rules = {table: Counter(rule for row in faults(broken, table) for rule in row.broken) for table in TABLES}
    for row in quality.q_pk(broken).collect():
        repeated = rules[row.table_name][f"{row.column_name} repeated"]
        assert repeated == row.surplus_rows + row.duplicate_keys
        assert rules[row.table_name][f"{row.column_name} is NULL"] == row.null_rows
    for row in quality.q_uniq(broken).collect():
        assert rules[row.table_name][f"{row.column_name} repeated"] == row.surplus_rows + row.duplicate_keys
    for row in quality.q_fk(broken).collect():
        assert rules[row.table_name][f"{row.column_name} not in {row.parent_table}"] == row.orphan_rows
    for row in quality.q_check(broken).collect():
        assert rules[row.table_name][row.rule] == row.violations
    for row in quality.q_nn(broken).collect():
        assert rules[row.table_name][f"{row.column_name} is NULL"] == row.null_rows


def separate_jobs(model):
    found = {(t, "rows", ""): model.table(t).count() for t in TABLES}
    found |= {(r.table_name, "null", r.column_name): r.null_rows for r in quality.q_nn(model).collect()}
    found |= {(r.table_name, "default", r.column_name): r.filled_rows for r in quality.q_def(model).collect()}
    return found | {(r.table_name, "check", r.rule): r.violations for r in quality.q_check(model).collect()}


def test_one_scan_counts_what_the_separate_jobs_count(broken):  # noqa: F811
    found = {(r.table_name, r.kind, r.name): r["rows"] for r in quarantine.q_scan(broken).collect()}
    assert found == separate_jobs(broken)


def test_rules_are_observed_while_tables_are_written(hand, tmp_path):
    """No scan more than the write's; the stored tables are the same."""
    found = {}
    write_tables(hand, str(tmp_path), watch=quarantine.watched(found))
    counts = {(t, *name.split(":", 1)): n for t, watch in found.items() for name, n in watch.get.items()}
    assert counts == separate_jobs(hand)


def test_each_table_is_scanned_once(spark):
    from tillscope.sources.star_schema import StarSchema

    text = quarantine.q_scan(StarSchema(spark, "/root/testdata/sf0.001"))._jdf.queryExecution()
    text = text.executedPlan().toString()
    assert text.count("FileScan parquet [l_") == 1 and text.count("FileScan parquet [o_") == 1
    assert PRIMARY_KEYS.keys() == set(TABLES)
