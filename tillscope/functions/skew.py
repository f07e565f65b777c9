"""Heavy hitters: keys that hold a large share of the rows, found in one pass and dealt out.

The adaptive split of a join starts only where a partition exceeds 256 MB and waits for
the shuffle to be measured. Here a mergeable frequent-items sketch finds the hot
keys first, whatever the size of a partition; their rows then go to many tasks,
and the one row of the other side that each of them needs goes along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that a sketch tracks: keys with over 1 / 7,500 of the rows are found for certain.
_TRACKED = 10_000
#: Hot keys that are dealt out, at most: with a larger share for each, fewer can exist.
_MOST = 1_000


def hot_keys(frame: DataFrame, column: str, share: float) -> list:
    """The values of a column that hold at least ``share`` of the rows. Runs a job when called.

    One pass with a sketch of fixed size per task; the sketches merge, and at most
    1,000 values come to the driver. A value may be listed that holds a little less.
    """
    if share < 1 / _MOST:
        raise ValueError(f"a hot key holds at least 1 / {_MOST} of the rows")
    found = frame.where(F.col(column).isNotNull()).agg(
        F.expr(f"approx_top_k({column}, {_MOST}, {_TRACKED})").alias("top"), F.count("*").alias("n")
    )
    row = found.first()
    return sorted(item for item, count in row.top or () if count >= share * row.n)


def dealt_join(
    rows: DataFrame, other: DataFrame, keys: list[str], hot_column: str, hot: list, how: str, ways: int
) -> DataFrame:
    """``rows`` joined with ``other``, which has one row per key; hot rows go ``ways`` ways.

    A hot row's way is a hash of all its columns. The rows of ``other`` with a hot key, as
    many as there are hot keys, are there once for each way. ``how``: inner or left_semi.
    """
    if not hot:
        return rows.join(other, keys, how)
    is_hot = F.coalesce(F.col(hot_column).isin(*hot), F.lit(False))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(ways)).cast("int")
    dealt = rows.withColumn("_way", F.when(is_hot, spread).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    copies = other.withColumn("_way", F.explode(every))
    return dealt.join(copies, [*keys, "_way"], how).drop("_way")
