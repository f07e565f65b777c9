"""Amounts and roundings against Python's Decimal on many random values."""

import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal, getcontext

from pyspark.sql import functions as F

from tillscope.functions.measures import (
    amount,
    carried_sums,
    from_cents,
    gross_micros,
    growth_pct,
    line_amount,
    line_sums,
    month_number,
    net_micros,
    ratio,
    rounded_div,
    share_pct,
    yearly_rate,
)

getcontext().prec = 60
PICK = random.Random(11)


def half_up(value, scale):
    return value.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP)


def test_ratios(spark):
    rows = []
    for _ in range(3000):
        top = Decimal(PICK.randrange(-(10**14), 10**14)).scaleb(-4)
        bottom = Decimal(PICK.choice([PICK.randrange(1, 50), PICK.randrange(1, 10**9)]))
        rows.append((top, bottom))
    frame = spark.createDataFrame(rows, "a decimal(24,4), b decimal(12,0)")
    found = frame.select(
        "a", "b", ratio("a", "b"), share_pct("a", "b"), growth_pct("a", "b", 1)
    ).collect()
    for top, bottom, plain, share, growth in found:
        assert plain == half_up(top / bottom, 2)
        assert share == half_up(top / bottom * 100, 1)
        assert growth == half_up((top - bottom) / bottom * 100, 1)


def test_yearly_rate_divides_first(spark):
    rows = [(n, days) for n in range(1, 12) for days in range(1, 2000, 7)]
    frame = spark.createDataFrame(rows, "n bigint, days int")
    for n, days, found in frame.select("n", "days", yearly_rate("n", "days")).collect():
        daily = half_up(Decimal(n) / days, 20)
        assert found == half_up(daily * 365, 2)


def test_line_amounts_and_their_sums(spark):
    rows = []
    for n in range(4000):
        price = Decimal(PICK.randrange(-(10**7), 10**9)).scaleb(-2)
        rows.append((n % 7, n % 50, PICK.randrange(1, 900), price, Decimal(PICK.randrange(0, 10001)).scaleb(-2)))
    frame = (
        spark.createDataFrame(
            rows, "g int, o int, q int, p decimal(10,2), d decimal(5,2)"
        )
        .repartition(5)
        .withColumn("gross_micros", gross_micros("q", "p"))
        .withColumn("net_micros", net_micros("gross_micros", "d"))
    )
    for row in frame.select("q", "p", "d", line_amount("net_micros").alias("net")).collect():
        assert row.net == half_up(row.q * row.p * (1 - row.d / 100), 2)

    gross, net = defaultdict(Decimal), defaultdict(Decimal)
    for group, _, quantity, price, discount in rows:
        gross[group] += quantity * price
        net[group] += quantity * price * (1 - discount / 100)
    once = frame.groupBy("g").agg(*line_sums("gross", "net"))
    twice = (
        frame.groupBy("g", "o").agg(*line_sums("gross", "net"))
        .groupBy("g").agg(*carried_sums("gross", "net"))
    )
    for sums in (once, twice):
        for row in sums.select("g", amount("gross").alias("a"), amount("net").alias("b")).collect():
            assert (row.a, row.b) == (gross[row.g], net[row.g])


def test_missing_amounts_are_left_out_of_sums(spark):
    frame = spark.createDataFrame([(1, 5_000_000), (1, None), (2, None)], "g int, net_micros bigint")
    sums = frame.groupBy("g").agg(*line_sums("net")).select("g", amount("net")).collect()
    assert sorted(map(tuple, sums)) == [(1, Decimal("5.000000")), (2, None)]


def test_integer_rounding(spark):
    rows = [(n, d) for n in range(-60, 61) for d in range(1, 12)]
    frame = spark.createDataFrame(rows, "n bigint, d bigint")
    for n, d, found in frame.select("n", "d", rounded_div(F.col("n"), F.col("d"))).collect():
        assert found == int(half_up(Decimal(n) / d, 0))
    assert spark.range(1).select(from_cents(F.lit(-1234))).first()[0] == Decimal("-12.34")


def test_month_distance(spark):
    frame = spark.sql("SELECT DATE '2022-12-31' AS a, DATE '2023-02-01' AS b")
    assert frame.select(month_number("b") - month_number("a")).first()[0] == 2
