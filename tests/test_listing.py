"""Ordered listings: names are added after the sort, and the order holds."""

import pytest
from pyspark.sql import functions as F

from tillscope.operators import joins
from tillscope.operators.dashboard import va1_order_listing
from tillscope.operators.joins import a1_order_details
from tillscope.sources.star_schema import StarSchema

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return StarSchema(spark, SF_DIR)


def operators(node):
    """The executed plan's operators, through the adaptive stages."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return operators(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return operators(node.plan())
    below = node.children()
    return [node, *(found for i in range(below.size()) for found in operators(below.apply(i)))]


def sorted_bytes(frame):
    """What went through the exchange of the sort."""
    found = operators(frame._jdf.queryExecution().executedPlan())
    sorts = [x for x in found if x.nodeName() == "Exchange" and "rangepartitioning" in x.simpleString(200)]
    return [x.metrics().apply("dataSize").value() for x in sorts]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("listing", [a1_order_details, va1_order_listing])
def test_order_and_rows_are_those_of_the_wide_sort(spark, star, monkeypatch, listing, threshold):
    """With Spark's own broadcast joins off, too."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, threshold)
    try:
        late = listing(star, ordered=True)
        rows = late.collect()
        monkeypatch.setattr(joins, "MOST_LOOKED_UP", 0)
        wide = listing(star, ordered=True)
        expected = wide.collect()
    finally:
        spark.conf.unset(key)
    assert sorted(map(str, rows)) == sorted(map(str, expected))
    assert [r.order_id for r in rows] == [r.order_id for r in expected]
    if listing is a1_order_details:
        keys = [(-r.order_date.toordinal(), r.order_id) for r in rows]
        assert keys == sorted(keys)
    (narrow,), (before,) = sorted_bytes(late), sorted_bytes(wide)
    assert narrow < 0.6 * before


def test_lines_of_unknown_customers_and_products_are_left_out(hand, monkeypatch):
    """As in the inner joins, whichever way names are added."""
    lines = hand.order_items.withColumn(
        "product_id", F.when(F.col("order_item_id") == 1, 77).otherwise(F.col("product_id"))
    )
    model = hand.with_tables(order_items=lines, customers=hand.customers.where("customer_id <> 2"))
    late = a1_order_details(model, ordered=True).collect()
    monkeypatch.setattr(joins, "MOST_LOOKED_UP", 0)
    assert late == a1_order_details(model, ordered=True).collect() and late
