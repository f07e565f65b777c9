"""Reports over rows whose references dangle, and the adapter on faulty source rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tillscope.catalog import run
from tillscope.operators.customers import d4_spend_quartiles, e1_top_customers_preagg, vc3_clv_ntile
from tillscope.operators.hierarchy import c2_category_tree
from tillscope.operators.insights import i1_top_products
from tillscope.operators.products import d1_top_products_by_region
from tillscope.functions.measures import rounded_div
from tillscope.sources import star_schema
from hand_model import build_model

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def broken(spark):
    """The given tables without the customer and the product that sell most."""
    star = star_schema.StarSchema(spark, SF_DIR)
    customer = e1_top_customers_preagg(star, k=1).first()["customer_id"]
    product = i1_top_products(star, k=1).first()["product_id"]

    class Broken(star_schema.StarSchema):
        def __init__(self):
            super().__init__(spark, SF_DIR)
            read = self._read

            def less(table):
                frame = read(table)
                if table == "customer":
                    return frame.filter(F.col("c_custkey") != customer)
                return frame.filter(F.col("p_partkey") != product) if table == "part" else frame

            self._read = less

        @property
        def customers(self):
            return super().customers.filter(F.col("customer_id") != customer)

        @property
        def products(self):
            return super().products.filter(F.col("product_id") != product)

    return Broken()


def test_top_lists_stay_full(broken):
    assert e1_top_customers_preagg(broken, k=2).count() == 2
    assert vc3_clv_ntile(broken, k=2).count() == 2
    assert i1_top_products(broken, k=2).count() == 2


def test_ranks_and_tiles_have_no_gaps(broken):
    best = d1_top_products_by_region(broken).collect()
    for region in {row.region_name for row in best}:
        assert min(row.region_rank for row in best if row.region_name == region) == 1
    sizes = [r["count"] for r in d4_spend_quartiles(broken).groupBy("spend_quartile").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_a_deep_chain_is_listed_whole(spark):
    rows = [(i, f"c{i}", i - 1 if i else None, True) for i in range(30)]
    listed = c2_category_tree(build_model(spark, categories=rows)).collect()
    assert [row.depth for row in listed] == list(range(30))


def test_faulty_source_rows_stay_visible(spark):
    orders = spark.createDataFrame(
        [(1, 1, "X"), (2, 1, None), (3, 1, "P")],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string",
    ).select("*", F.lit(datetime.datetime(2020, 1, 1)).alias("o_orderdate"), F.lit("1").alias("o_orderpriority"))
    states = [r.status for r in star_schema._orders(orders).orderBy("order_id").collect()]
    assert states == ["X", None, "Cancelled"]
    line = spark.sql(
        "SELECT 1L AS l_orderkey, 1L AS l_partkey, 1 AS l_linenumber, 0D AS l_quantity,"
        " 10D AS l_extendedprice, 0D AS l_discount"
    )
    assert star_schema._order_items(line).first()["unit_price"] is None


def test_rounding_of_negative_denominators(spark):
    pairs = [(100, -3), (-100, -3), (100, 3), (-5, 2)]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    found = [r[0] for r in frame.select(rounded_div(F.col("a"), F.col("b"))).collect()]
    assert found == [-33, 33, 33, -3]


def test_unknown_parameters_are_refused(broken):
    with pytest.raises(TypeError):
        run(broken, "d2_month_over_month", scael=0)
