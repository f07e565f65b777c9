"""Row counts of the model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.model import RetailModel
from tillscope.plans.frames import listed
from tillscope.schema import TABLES

TOTAL_LABEL = "--- TOTAL ---"


def g7_row_counts(model: RetailModel, total: bool = True) -> DataFrame:
    """One row per table, and a last row that adds up those counts."""
    counts = reduce(
        DataFrame.unionAll,
        [
            model.table(name).agg(
                F.lit(name).alias("tbl"), F.lit(place).alias("place"), F.count("*").alias("rows")
            )
            for place, name in enumerate(TABLES)
        ],
    )
    if not total:
        return counts.drop("place")
    return (
        counts.rollup("tbl")
        .agg(F.sum("rows").alias("rows"), F.grouping("tbl").alias("last"), F.min("place"))
        .transform(listed, "last", "min(place)")
        .select(F.coalesce("tbl", F.lit(TOTAL_LABEL)).alias("tbl"), "rows")
    )
