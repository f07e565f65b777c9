"""The metric layer: every amount, ratio and date bucket is defined once, here.

Money is exact from scan to report: whole numbers while it is summed, DECIMAL
when it is shown. Rounding is half away from zero, which is what ``round`` does
on DECIMAL columns; doubles are never rounded.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.schema import VOID_STATUSES

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Sales(Enum):
    """Which orders an analysis counts."""

    ANY = "every order"
    VALID = "neither cancelled nor returned"
    DELIVERED = "delivered"


def counted(sales: Sales, status: ColumnOrName = "status") -> Column:
    """The status filter for ``sales``; an unknown (NULL) status is no valid sale."""
    if sales is Sales.VALID:
        return ~_col(status).isin(*VOID_STATUSES)
    if sales is Sales.DELIVERED:
        return _col(status) == "Delivered"
    return F.lit(True)


# Line amounts are bigint millionths of the currency unit ("micros"): a price in
# cents times a discount in hundredths of a percent is a whole number of them.
_MICROS_PER_CENT = 10_000


def gross_micros(quantity: ColumnOrName, unit_price: ColumnOrName) -> Column:
    """quantity x unit price, for lines below 9.2 * 10**12 (beyond is an overflow error)."""
    cents = _col(unit_price).cast("decimal(16,2)") * F.lit(100)
    return _col(quantity).cast("bigint") * cents.cast("bigint") * _MICROS_PER_CENT


def net_micros(gross: ColumnOrName, discount_pct: ColumnOrName) -> Column:
    """Gross less the line's own percentage discount."""
    basis_points = (_col(discount_pct).cast("decimal(7,2)") * F.lit(100)).cast("bigint")
    return F.call_function("div", _col(gross), F.lit(_MICROS_PER_CENT)) * (10_000 - basis_points)


# A bigint sum of micros would end at 9.2 * 10**12 units of currency, too little
# for large tables, and a DECIMAL sum is slower and wider in every shuffle. So a
# sum is carried as two bigints, of the high and of the low parts of the lines.
# Both stay far from overflow, and only reports put them together.
_LOW_BITS = 20


def line_sums(*names: str) -> list[Column]:
    """Aggregates over lines: two partial sums for each amount ``<name>_micros``."""
    sums = []
    for name in names:
        micros = F.col(f"{name}_micros")
        sums.append(F.sum(F.shiftright(micros, _LOW_BITS)).alias(f"{name}_high"))
        sums.append(F.sum(micros.bitwiseAND(2**_LOW_BITS - 1)).alias(f"{name}_low"))
    return sums


def carried_sums(*names: str) -> list[Column]:
    """Aggregates over rows that hold partial sums already."""
    parts = [f"{name}_{part}" for name in names for part in ("high", "low")]
    return [F.sum(part).alias(part) for part in parts]


def amount(name: str) -> Column:
    """The exact DECIMAL value of a pair of partial sums."""
    high = F.col(f"{name}_high").cast("decimal(19,0)") * F.lit(2**_LOW_BITS)
    micros = high + F.col(f"{name}_low").cast("decimal(19,0)")
    return (micros * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(30,6)")


def rounded_div(numerator: Column, denominator: Column) -> Column:
    """Integer quotient, rounded half away from zero; NULL for a NULL denominator."""
    half = F.when((numerator < 0) != (denominator < 0), -denominator).otherwise(denominator)
    return F.call_function("div", numerator * 2 + half, denominator * 2)


def from_cents(cents: Column) -> Column:
    """Whole cents as money."""
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")


def line_amount(micros: ColumnOrName) -> Column:
    """A single line's amount as money."""
    return from_cents(rounded_div(_col(micros), F.lit(_MICROS_PER_CENT)))


def money(amount: ColumnOrName) -> Column:
    """Round to cents."""
    return F.round(_col(amount), 2).cast("decimal(22,2)")


def ratio(
    numerator: ColumnOrName, denominator: ColumnOrName, scale: int = 2, per: int = 1
) -> Column:
    """numerator / denominator x per, rounded; NULL for a zero denominator.

    The casts fix Spark's result type at 14 decimals for operands below 10**18;
    left alone, DECIMAL(38, .) division would keep as few as six.
    """
    top = _col(numerator).cast("decimal(24,6)")
    bottom = _col(denominator).cast("decimal(24,6)")
    quotient = (top / F.nullif(bottom, F.lit(0))).cast("decimal(30,14)")
    return F.round(quotient * F.lit(per), scale).cast(f"decimal(20,{scale})")


def share_pct(part: ColumnOrName, whole: ColumnOrName, scale: int = 1) -> Column:
    return ratio(part, whole, scale, per=100)


def growth_pct(current: ColumnOrName, previous: ColumnOrName, scale: int = 2) -> Column:
    return ratio(_col(current) - _col(previous), previous, scale, per=100)


def yearly_rate(events: ColumnOrName, days: ColumnOrName) -> Column:
    """events / days x 365 to two decimals.

    The daily rate is held at 20 decimals before it is scaled up: the order of
    the two steps shows in results such as 2 events in 1168 days (0.62, not 0.63).
    """
    daily = _col(events).cast("decimal(21,9)") / F.nullif(
        _col(days).cast("decimal(10,0)"), F.lit(0)
    )
    return F.round(daily * F.lit(365), 2).cast("decimal(20,2)")


def month_of(day: ColumnOrName) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(_col(day), "MM")


def month_number(day: ColumnOrName) -> Column:
    """Months counted from year 0, for whole-month distances."""
    return F.year(_col(day)).cast("bigint") * 12 + F.month(_col(day))
