"""Column defaults, applied while loading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.schema import DEFAULTS


def with_defaults(table: str, frame: DataFrame) -> DataFrame:
    """Replace NULLs by the declared default of their column."""
    kinds = dict(frame.dtypes)
    return frame.withColumns(
        {
            column: F.coalesce(F.col(column), F.lit(value).cast(kinds[column]))
            for column, value in DEFAULTS[table].items()
        }
    )
