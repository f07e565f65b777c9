"""The category tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.model import RetailModel
from tillscope.session import durable


def c2_category_tree(model: RetailModel) -> DataFrame:
    """Depth-first listing of all categories below a root, with depth and path.

    Every category knows the way up to some ancestor; each round joins it with the way
    from there on, so ways double and a tree of n levels takes log2(n) rounds, however
    many rows it has. A way that meets a category twice is dropped, so a cycle ends;
    what hangs on a missing parent or a cycle is below no root and is not listed.
    """
    ways = durable(
        model.categories.select(
            "category_id",
            "category_name",
            "is_active",
            F.col("parent_id").alias("above"),
            F.array("category_id").alias("id_path"),
            F.col("category_name").alias("full_path"),
        )
    )
    while not ways.filter("above IS NOT NULL").isEmpty():
        onward = ways.select(
            F.col("category_id").alias("from_id"),
            F.col("above").alias("next_above"),
            F.col("id_path").alias("upper_ids"),
            F.col("full_path").alias("upper_path"),
        )
        longer = (
            ways.join(onward, F.col("above") == F.col("from_id"))
            .filter(~F.arrays_overlap("upper_ids", "id_path"))
            .select(
                "category_id",
                "category_name",
                "is_active",
                F.col("next_above").alias("above"),
                F.concat("upper_ids", "id_path").alias("id_path"),
                F.concat("upper_path", F.lit(" > "), "full_path").alias("full_path"),
            )
        )
        ways = durable(ways.filter("above IS NULL").unionByName(longer))
    depth = F.size("id_path") - 1
    return ways.orderBy("id_path").select(
        "category_id",
        F.concat(F.repeat(F.lit("    "), depth), "category_name").alias("indented_name"),
        depth.cast("bigint").alias("depth"),
        "full_path",
        "is_active",
    )
