"""Written layouts: same results, and scans and joins that profit from them."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tillscope.catalog import OPERATORS, run
from tillscope.functions.measures import Sales
from tillscope.operators.joins import a3_segment_revenue
from tillscope.operators.trends import e2_monthly_gross, e2_monthly_gross_preproject
from tillscope.schema import SCHEMAS, TABLES
from tillscope.sources.star_schema import AS_OF, STORED_SCHEMAS, StarSchema
from tillscope.sources.tables import (
    open_tables,
    read_tables,
    save_bucketed,
    store_order_totals,
    write_tables,
)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, standard, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    write_tables(standard, root)
    write_tables(standard, root)  # overwriting is safe to repeat
    return read_tables(spark, root)


@pytest.fixture(scope="module")
def bucketed(spark, standard):
    spark.sql("CREATE DATABASE IF NOT EXISTS retail")
    save_bucketed(standard, "retail", buckets=4)
    return open_tables(spark, "retail")


def test_round_trip_keeps_columns_types_and_rows(standard, stored):
    for table in TABLES:
        before, after = standard.table(table), stored.table(table)
        assert after.columns == SCHEMAS[table].names
        assert [f.dataType for f in after.schema] == [f.dataType for f in SCHEMAS[table]]
        assert after.exceptAll(before.select(after.columns)).count() == 0
        assert after.count() == before.count()


def test_results_do_not_depend_on_the_layout(standard, stored, bucketed):
    expected = a3_segment_revenue(standard).collect()
    assert a3_segment_revenue(stored).collect() == expected
    assert a3_segment_revenue(bucketed).collect() == expected
    months = e2_monthly_gross(standard).collect()
    assert e2_monthly_gross(stored).collect() == months
    assert [tuple(r) for r in e2_monthly_gross_preproject(bucketed).collect()] == [
        tuple(r) for r in months
    ]


def test_status_filter_prunes_folders(stored):
    text = plan(stored.kept_orders(Sales.DELIVERED).filter(f"order_date >= '{date(2023, 1, 1)}'"))
    assert "PartitionFilters: [isnotnull(status" in text
    assert "PushedFilters: [IsNotNull(order_date), GreaterThanOrEqual(order_date" in text


def test_buckets_save_the_exchanges_on_order_id(spark, bucketed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(bucketed.order_totals)
        orders = bucketed.kept_orders(Sales.VALID).select("order_id", "customer_id")
        joined = plan(orders.join(bucketed.order_totals, "order_id"))
        assert "SortMergeJoin" in joined and "Exchange" not in joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_oversized_order_is_one_row_of_a_bucket(spark, standard):
    lines = standard.order_items
    hot = lines.withColumn("order_id", F.when(F.col("order_id") % 3 == 0, 3).otherwise(F.col("order_id")))
    heavy = standard.with_tables(order_items=hot)
    spark.sql("CREATE DATABASE IF NOT EXISTS retail_hot")
    save_bucketed(heavy, "retail_hot", buckets=4)
    opened = open_tables(spark, "retail_hot")
    assert opened.order_items.count() == lines.count()
    assert opened.order_totals.filter("order_id = 3").count() == 1
    assert a3_segment_revenue(opened).collect() == a3_segment_revenue(heavy).collect()


def test_stored_totals_replace_the_lines(stored, tmp_path):
    folded = store_order_totals(stored, str(tmp_path / "totals"))
    assert a3_segment_revenue(folded).collect() == a3_segment_revenue(stored).collect()
    assert "unit_price" not in plan(a3_segment_revenue(folded))
    assert e2_monthly_gross(folded).collect() == e2_monthly_gross(stored).collect()
    assert "unit_price" not in plan(e2_monthly_gross(folded))
    assert folded.with_tables(regions=stored.regions).totals_stored
    again = folded.with_tables(order_items=stored.order_items.limit(0))
    assert a3_segment_revenue(again).count() == 0


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The given star schema, and the same data stored in the plain layout."""
    given = StarSchema(spark, "/root/testdata/sf0.001")
    root = str(tmp_path_factory.mktemp("landed"))
    write_tables(given, root, STORED_SCHEMAS)
    return given, read_tables(spark, root, STORED_SCHEMAS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_stored_star_schema_gives_the_same_reports(landed, name):
    parameters = {"as_of": AS_OF, "source": "BUILDING", "target": "MACHINERY"}
    given, stored = (run(model, name, **parameters) for model in landed)
    assert given.columns == stored.columns
    assert sorted(map(str, given.collect())) == sorted(map(str, stored.collect()))
