"""A small model made by hand, and how to build variants of it."""

from datetime import date
from decimal import Decimal

from tillscope.model import RetailModel
from tillscope.schema import SCHEMAS

HAND = {
    "regions": [(1, "North", "United States"), (2, "South", "United States")],
    "categories": [
        (1, "Tools", None, True),
        (2, "Toys", None, True),
        (3, "Books", None, False),
        (4, "Drills", 1, True),
        (5, "Hammer drills", 4, True),  # third level
        (6, "Puzzles", 2, True),
        (7, "Lost", 99, True),  # parent does not exist
    ],
    "customers": [
        (1, "Ann", "Lee", "ann@x", None, 1, "Gold", date(2020, 1, 1), True),
        (2, "Bob", "Ray", "bob@x", None, 1, "Gold", date(2019, 1, 1), True),
        (3, "Cy", "Poe", "cy@x", "1", 2, "Bronze", date(2021, 1, 1), True),  # one order
        (4, "Di", "Fox", "di@x", "2", 2, "Bronze", date(2018, 1, 1), True),  # only cancelled
        (5, "Ed", "Kay", "ed@x", "3", 2, "Silver", date(2017, 1, 1), True),  # none
        (6, "Flo", "Day", "flo@x", "4", 1, "Silver", date(2016, 1, 1), False),  # none, inactive
    ],
    "products": [
        (1, "drill", 4, "60.00", "100.00", 5, True),
        (2, "hammer drill", 5, "50.00", "200.00", 5, True),
        (3, "jigsaw puzzle", 6, "5.00", "10.00", 5, True),
        (4, "never sold", 6, "1.00", "3.00", 5, True),
        (5, "free", 3, "0.00", "0.00", 5, False),
    ],
    "orders": [
        (1, 1, date(2023, 1, 10), None, "Delivered", "Card", "0.00"),
        (2, 1, date(2023, 1, 31), None, "Shipped", "Card", "0.00"),
        (3, 1, date(2023, 4, 2), None, "Returned", "Card", "0.00"),
        (4, 2, date(2023, 4, 30), None, "Delivered", "Card", "10.00"),
        (5, 2, date(2022, 12, 31), None, "Processing", "Card", "0.00"),
        (6, 3, date(2023, 6, 1), None, "Delivered", "Card", "0.00"),
        (7, 4, date(2023, 6, 2), None, "Cancelled", "Card", "0.00"),
        (8, 2, date(2023, 5, 5), None, "Delivered", "Card", "0.00"),  # no lines
    ],
    "order_items": [
        (1, 1, 1, 1, "100.00", "0.00"),
        (2, 1, 3, 2, "10.00", "0.00"),
        (3, 2, 1, 1, "100.00", "0.00"),
        (4, 3, 2, 1, "200.00", "0.00"),
        (5, 4, 1, 2, "90.00", "10.00"),
        (6, 5, 3, 3, "10.00", "12.50"),
        (7, 6, 3, 1, "10.05", "50.00"),
        (8, 7, 2, 1, "200.00", "0.00"),
    ],
}

_DECIMALS = {"products": (3, 4), "orders": (6,), "order_items": (4, 5)}


def build_model(spark, rows=HAND, **overrides):
    """The hand-made model, with whole tables replaced by ``overrides``."""
    frames = {}
    for table, data in {**rows, **overrides}.items():
        places = _DECIMALS.get(table, ())
        typed = [
            tuple(
                Decimal(v) if i in places and v is not None else v for i, v in enumerate(row)
            )
            for row in data
        ]
        frames[table] = spark.createDataFrame(typed, SCHEMAS[table])
    return RetailModel(**frames)
