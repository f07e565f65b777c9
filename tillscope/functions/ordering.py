"""Positions, ranks and tiles over a whole table without a one-task window.

``row_number() over (order by ...)`` moves every row into a single task. Here
positions come from rows that are range-partitioned on the sort key, numbered
inside their partition and shifted by the row counts of the partitions before
them; only that list of counts, one row per partition, is ever brought together.
Ranks and the cuts between tiles need no sorted table: they come from exact
counts of slots of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillscope.session import durable

# monotonically_increasing_id keeps the partition number above bit 33 and the
# row's number inside the partition below it.
_ROW_BITS = 33


def _numbered(frame: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in range partitions, each with its partition and row number in ``_seq``."""
    return durable(
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )


def _placed(numbered: DataFrame, name: str, total: str = "_total") -> DataFrame:
    """Replace ``_seq`` by the position in the whole table, and add its number of rows."""
    part = F.shiftright("_seq", _ROW_BITS)
    row = F.col("_seq") - F.shiftleft(part, _ROW_BITS)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(W.partitionBy()).alias(total),
        )
    )
    # Bounded by the number of shuffle partitions, whatever the table's size.
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + row + 1)
        .drop("_part", "_seq", "_before")
    )


def with_position(frame: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in ``order``. Runs a job when called.

    ``order`` should end with a unique key: it makes positions reproducible and
    lets a run of equal values spread over several partitions.
    """
    return _placed(_numbered(frame, order), name).drop("_total")


def with_ntile(
    frame: DataFrame, tiles: int, order: list[Column], name: str = "tile"
) -> DataFrame:
    """Add NTILE(tiles) in ``order``: the first (rows mod tiles) tiles get one row more."""
    placed = _placed(_numbered(frame, order), "_position")
    rows = F.col("_total")
    base = F.call_function("div", rows, F.lit(tiles))
    extra = rows % tiles
    longer = extra * (base + 1)
    before = F.col("_position") - 1
    tile = F.when(before < longer, F.call_function("div", before, base + 1)).otherwise(
        extra + F.call_function("div", before - longer, base)
    )
    return placed.withColumn(name, tile + 1).drop("_position", "_total")


def _place_among(value: Column, cuts: Column) -> Column:
    """How many of the ascending ``cuts`` are less than a value, by binary search."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int") + 1)

    def halved(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        less = F.get(cuts, middle) < value
        return F.when(low >= high, state).otherwise(
            F.struct(
                F.when(less, middle + 1).otherwise(low).alias("low"),
                F.when(less, high).otherwise(middle).alias("high"),
            )
        )

    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(steps, start, halved, lambda state: state["low"])


def with_rank(
    frame: DataFrame, value: str, key: str, name: str = "rank", slots: int | None = None
) -> DataFrame:
    """Add RANK() over a numeric ``value`` descending, NULL values ranked first.

    A rank is one more than the number of rows with a greater value. Approximate
    quantiles cut the values into slots: the open intervals between two cuts, and
    the cuts themselves. A value that many rows share is a cut, so no interval
    holds more than its share of rows. Rows are dealt once, by slot, those of a cut
    (or NULL) anywhere, by ``key``, since all of them have the slot's first rank;
    the exact counts of the slots add what lies before. The cuts and the counts
    are one row each, whatever the table's size, and subqueries of the same plan.
    """
    session = frame.sparkSession
    slots = slots or 4 * int(session.conf.get("spark.sql.shuffle.partitions"))
    shares = [n / slots for n in range(slots + 1)]
    quantiles = F.percentile_approx(value, shares, 20 * slots)
    cuts = frame.agg(F.array_sort(F.array_distinct(quantiles)).alias("cuts")).scalar()
    place = F.when(F.col(value).isNotNull(), _place_among(F.col(value), F.col("_cuts")))
    slotted = (
        frame.withColumn("_cuts", F.coalesce(cuts, F.array().cast(f"array<{_type(frame, value)}>")))
        .withColumn("_place", place)
        .withColumn("_cut", F.coalesce(F.get("_cuts", F.col("_place")) == F.col(value), F.lit(False)))
        .withColumn("_slot", F.coalesce(2 * F.col("_place") + F.col("_cut").cast("int"), F.lit(-1)))
        .drop("_cuts", "_place", "_cut")
    )
    first = F.when(F.col("_slot") < 0, F.lit(2**31 - 1)).otherwise(F.col("_slot")).desc()
    earlier = W.orderBy(first).rowsBetween(W.unboundedPreceding, -1)
    counts = (
        slotted.groupBy("_slot")
        .agg(F.count("*").alias("_rows"))
        .select("_slot", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
        .agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_before"))).alias("before"))
        .scalar()
    )
    # Odd slots are cuts, -1 is NULL.
    single = F.col("_slot") % 2 != 0
    dealt = F.when(single, F.pmod(F.xxhash64(key), F.lit(slots))).otherwise(F.lit(-1))
    inside = W.partitionBy("_slot", "_dealt").orderBy(F.col(value).desc())
    return (
        slotted.withColumn("_dealt", dealt)
        .withColumn("_inside", F.rank().over(inside))
        .withColumn(name, F.element_at(counts, F.col("_slot")) + F.col("_inside"))
        .drop("_slot", "_dealt", "_inside")
    )


def _type(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def _groups(column: str, fineness: int) -> Column:
    """A whole number that never falls where the column's number rises; NULL comes first.

    Some 2,000 for each factor of e, so under 200,000 for numbers up to 10**20 on either
    side of zero; ``fineness`` cuts each of them in so many.
    """
    number = F.col(column).cast("double")
    whole = F.floor(F.signum(number) * F.log1p(F.abs(number)) * (2000 * fineness)).cast("bigint")
    return F.coalesce(whole, F.lit(-(2**60)))


#: So many rows around the end of a tile may be looked at one by one.
_FEW = 1000


def tile_cuts(frame: DataFrame, tiles: int, value: str, key: str) -> list[tuple]:
    """(value, key) of the last row of every tile but the last one, of NTILE in (value, key).

    Runs jobs when called. Nothing is sorted or numbered: exact counts of coarse groups
    of values tell in which of them a tile ends, and finer groups of the rows in that
    one, until they are few or have one value; the rows of one value are narrowed
    down by their keys alike. What comes to the driver is bounded whatever the size
    of the table. Both columns are numbers, NULL values come first, keys are unique.
    A tile without rows ends where the one before it does; NTILE fills the first ones.
    """

    def ended(counts: list, left: int) -> tuple:
        """The group that holds the ``left``-th row, its rows, and its place among these."""
        for group, rows in sorted(counts, key=lambda c: (c[0] is not None, c[0])):
            if left <= rows:
                return group, rows, left
            left -= rows
        raise ValueError("rows changed while they were counted")

    def counted(rows: DataFrame, group: Column) -> list:
        return [tuple(row) for row in rows.groupBy(group).agg(F.count("*")).collect()]

    def in_order(rows: list) -> list:
        return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, *r))

    def last_row(rows: DataFrame, size: int, left: int) -> tuple:
        for column in (value, key):
            for group in (_groups(column, 1), _groups(column, 1024), F.col(column)):
                if size <= _FEW:
                    return in_order(rows.select(value, key).collect())[left - 1]
                wanted, size, left = ended(counted(rows, group), left)
                rows = rows.where(group.eqNullSafe(F.lit(wanted)))
        return in_order(rows.select(value, key).collect())[left - 1]

    coarse = _groups(value, 1)
    counts = counted(frame, coarse)
    total = sum(rows for _, rows in counts)
    ends = [total // tiles * tile + min(tile, total % tiles) for tile in range(1, tiles)]
    held = [ended(counts, end) for end in ends if end]
    # One job for all tiles that end among few rows.
    few = {group for group, size, _ in held if size <= _FEW}
    near: dict[int, list] = {group: [] for group in few}
    if few:
        for group, *row in frame.where(coarse.isin(*few)).select(coarse, value, key).collect():
            near[group].append(row)
    return [
        in_order(near[group])[left - 1]
        if group in few
        else last_row(frame.where(coarse == group), size, left)
        for group, size, left in held
    ]


def tile_of(cuts: list[tuple], value: str, key: str) -> Column:
    """The tile of a row, given ``tile_cuts``: one more than the cuts before it."""
    tile = F.lit(1).cast("bigint")
    for cut_value, cut_key in cuts:
        last = F.lit(cut_value)
        later = F.col(value).eqNullSafe(last) & (F.col(key) > cut_key)
        above = F.col(value).isNotNull() if cut_value is None else F.col(value) > last
        tile = tile + F.when(later | above, 1).otherwise(0)
    return tile
