"""Distributed positions, tiles and ranks against the one-task window functions."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillscope.functions import ordering
from tillscope.functions.ordering import with_ntile, with_position, with_rank


def numbers(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, value long").repartition(7)


def samples():
    pick = random.Random(7)
    spread = [pick.randrange(10**6) for _ in range(3000)]
    few = [pick.randrange(5) for _ in range(2000)]
    hot = [42] * 1000 + [pick.randrange(100) for _ in range(2000)]
    missing = [None] * 700 + [pick.randrange(50) for _ in range(700)]
    return {"spread": spread, "few": few, "hot": hot, "missing": missing, "one": [3], "none": []}


@pytest.mark.parametrize("name", list(samples()))
def test_positions_and_ranks(spark, name):
    frame = numbers(spark, samples()[name])
    order = [F.col("value").desc_nulls_first(), F.col("id").asc()]
    whole = W.orderBy(*order)
    expected = frame.select(
        "id",
        F.row_number().over(whole).alias("position"),
        F.rank().over(W.orderBy(F.col("value").desc_nulls_first())).alias("rank"),
    )
    placed = with_position(frame, order).select("id", "position")
    ranked = with_rank(frame, "value", "id").select("id", "rank")
    assert sorted(placed.join(ranked, "id").collect()) == sorted(expected.collect())


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 7, 8, 101, 1001])
def test_tiles(spark, rows):
    frame = numbers(spark, [row % 11 for row in range(rows)])
    order = [F.asc("value"), F.asc("id")]
    expected = frame.select("id", F.ntile(4).over(W.orderBy(*order)))
    found = with_ntile(frame, 4, order).select("id", "tile")
    assert sorted(found.collect()) == sorted(expected.collect())


@pytest.mark.parametrize("few", [1, 1000])
@pytest.mark.parametrize("name, tiles", [*((name, 4) for name in samples()), ("hot", 1), ("few", 7)])
def test_exact_cuts_of_tiles(spark, monkeypatch, few, name, tiles):
    """Ties, NULLs, one row, fewer rows than tiles, values of every size and sign."""
    monkeypatch.setattr(ordering, "_FEW", few)
    values = [None if v is None else (v - 20) * 10 ** (v % 12) for v in samples()[name]]
    frame = numbers(spark, values)
    expected = frame.select("id", F.ntile(tiles).over(W.orderBy("value", "id")).cast("bigint"))
    cuts = ordering.tile_cuts(frame, tiles, "value", "id")
    found = frame.select("id", ordering.tile_of(cuts, "value", "id"))
    assert sorted(found.collect()) == sorted(expected.collect())


def rows_in_tasks(frame):
    rows = frame.groupBy(F.spark_partition_id()).agg(F.count("rank").alias("n")).collect()
    return sorted(row.n for row in rows)


def test_a_million_equal_values_make_no_large_task(spark):
    """A million NULL values and as many zeros among two million others, in 16 tasks."""
    n = F.col("id")
    value = F.when(n % 4 == 0, None).when(n % 4 == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)))
    frame = spark.range(4_000_000).withColumn("value", value)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, setting in settings.items():
        spark.conf.set(key, setting)
    try:
        ranked = with_rank(frame, "value", "id")
        tasks = rows_in_tasks(ranked)
        assert sum(tasks) == 4_000_000 and len(tasks) == 16 and tasks[-1] < 2 * tasks[8]
        found = ranked.groupBy("value").agg(F.min("rank").alias("rank"), F.max("rank").alias("most"))
        heavy = {row.value: row for row in found.where("value IS NULL OR value = 0").collect()}
        more = frame.where("value > 0").count()
        assert (heavy[None].rank, heavy[None].most) == (1, 1)
        assert (heavy[0].rank, heavy[0].most) == (1_000_001 + more, 1_000_001 + more)
        text = ranked._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(_slot#\d+L?, _dealt", text)) == 1
        assert "rangepartitioning" not in text and "ExistingRDD" not in text
    finally:
        for key, setting in before.items():
            spark.conf.set(key, setting)


def test_positions_come_from_many_partitions(spark):
    """With adaptive coalescing off, rows really are numbered in several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = numbers(spark, list(range(5000)))
        placed = with_position(frame, [F.desc("value"), F.asc("id")])
        assert [r.position for r in placed.orderBy(F.desc("value")).collect()] == list(
            range(1, 5001)
        )
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
