"""Literal reference data: regions, the category tree and the product catalogue."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from tillscope.schema import DEFAULT_COUNTRY, SCHEMAS

# Ids are positions, counted from 1.
REGIONS = ("North East", "South East", "Mid West", "South West", "West Coast", "Northwest")

# Fixed values: (name, parent position or None, active); ids are positions.
CATEGORIES = (
    ("Electronics", None, True),
    ("Clothing & Apparel", None, True),
    ("Home & Garden", None, True),
    ("Sports & Outdoors", None, True),
    ("Books & Media", None, False),
    ("Food & Beverage", None, True),
    ("Smartphones", 1, True),
    ("Laptops", 1, True),
    ("Audio", 1, True),
    ("Wearables", 1, True),
    ("Men's Clothing", 2, True),
    ("Women's Clothing", 2, True),
    ("Footwear", 2, True),
    ("Furniture", 3, True),
    ("Kitchen", 3, True),
    ("Garden Tools", 3, True),
    ("Fitness", 4, True),
    ("Camping", 4, True),
    ("Nutrition", 6, True),
    ("Beverages", 6, True),
)

# Fixed values: (name, category position, cost, price, stock); ids are positions.
PRODUCTS = (
    ("Samsung Galaxy S24 Ultra", 7, "820.00", "1199.99", 450),
    ("Apple iPhone 15 Pro", 7, "780.00", "1099.99", 320),
    ("Google Pixel 8 Pro", 7, "580.00", "899.99", 280),
    ("OnePlus 12", 7, "420.00", "649.99", 210),
    ("Motorola Edge 40 Pro", 7, "310.00", "499.99", 180),
    ("Dell XPS 15 Laptop", 8, "950.00", "1499.99", 200),
    ('Apple MacBook Pro 14"', 8, "1200.00", "1999.99", 150),
    ("Lenovo ThinkPad X1 Carbon", 8, "880.00", "1349.99", 175),
    ("HP Spectre x360", 8, "750.00", "1149.99", 220),
    ("ASUS ROG Gaming Laptop", 8, "870.00", "1299.99", 130),
    ("Sony WH-1000XM5 Headphones", 9, "180.00", "349.99", 600),
    ("Apple AirPods Pro 2nd Gen", 9, "140.00", "249.99", 850),
    ("Bose QuietComfort 45", 9, "160.00", "299.99", 420),
    ("JBL Charge 5 Speaker", 9, "80.00", "149.99", 380),
    ("Sonos Era 100", 9, "150.00", "249.99", 200),
    ("Apple Watch Series 9", 10, "270.00", "399.99", 520),
    ("Samsung Galaxy Watch 6", 10, "180.00", "279.99", 310),
    ("Fitbit Charge 6", 10, "90.00", "159.99", 480),
    ("Garmin Forerunner 965", 10, "290.00", "499.99", 180),
    ("Levi's 501 Original Jeans", 11, "28.00", "69.99", 900),
    ("Ralph Lauren Oxford Shirt", 11, "22.00", "54.99", 750),
    ("Nike Dri-FIT T-Shirt", 11, "14.00", "34.99", 1200),
    ("Patagonia Fleece Jacket", 11, "55.00", "129.99", 400),
    ("Adidas Track Pants", 11, "18.00", "44.99", 600),
    ("Zara Floral Midi Dress", 12, "25.00", "59.99", 700),
    ("H&M Knit Sweater", 12, "15.00", "39.99", 850),
    ("Anthropologie Blazer", 12, "60.00", "139.99", 250),
    ("Lululemon Align Leggings", 12, "42.00", "98.00", 650),
    ("J.Crew Chambray Blouse", 12, "20.00", "49.99", 500),
    ("Nike Air Max 270", 13, "60.00", "149.99", 800),
    ("Adidas Ultraboost 23", 13, "80.00", "179.99", 600),
    ('Timberland 6" Boot', 13, "75.00", "169.99", 350),
    ("Birkenstock Arizona", 13, "45.00", "109.99", 420),
    ("Converse Chuck Taylor", 13, "25.00", "59.99", 950),
    ("IKEA BEKANT Desk", 14, "95.00", "249.99", 120),
    ("Herman Miller Aeron Chair", 14, "800.00", "1495.00", 60),
    ("West Elm Mid-Century Sofa", 14, "650.00", "1299.99", 40),
    ("Wayfair Bookshelf", 14, "55.00", "149.99", 200),
    ("Pottery Barn Coffee Table", 14, "220.00", "549.99", 80),
    ("Instant Pot Duo 7-in-1", 15, "45.00", "99.99", 500),
    ("KitchenAid Stand Mixer", 15, "180.00", "449.99", 160),
    ("Ninja Air Fryer", 15, "60.00", "129.99", 450),
    ("Vitamix Blender", 15, "200.00", "549.99", 100),
    ("Cuisinart Coffee Maker", 15, "45.00", "89.99", 350),
    ("Black+Decker Cordless Drill", 16, "40.00", "79.99", 400),
    ("Husqvarna Gas Trimmer", 16, "110.00", "249.99", 150),
    ("Fiskars Pruning Shears", 16, "12.00", "24.99", 800),
    ("DeWalt 20V Chainsaw", 16, "160.00", "329.99", 120),
    ("Peloton Bike+", 17, "1800.00", "2495.00", 30),
    ("Bowflex SelectTech Dumbbells", 17, "150.00", "329.99", 200),
    ("TRX Suspension Trainer", 17, "55.00", "119.99", 300),
    ("Yoga Mat Premium", 17, "18.00", "44.99", 700),
    ("Resistance Band Set", 17, "8.00", "24.99", 1000),
    ("REI Co-op Half Dome Tent", 18, "120.00", "279.99", 180),
    ("Coleman Sleeping Bag", 18, "35.00", "79.99", 350),
    ("Yeti Tundra 45 Cooler", 18, "175.00", "349.99", 140),
    ("Hydro Flask Water Bottle", 18, "18.00", "44.99", 900),
    ("Black Diamond Headlamp", 18, "20.00", "44.99", 450),
    ("Optimum Nutrition Whey 5lb", 19, "28.00", "64.99", 600),
    ("Orgain Organic Protein", 19, "22.00", "49.99", 500),
    ("Garden of Life Multivitamin", 19, "18.00", "39.99", 700),
    ("NOW Foods Vitamin D3", 19, "5.00", "14.99", 1200),
    ("Omega-3 Fish Oil 1000mg", 19, "8.00", "19.99", 1100),
    ("Nespresso Vertuo Next", 20, "80.00", "179.99", 300),
    ("Keurig K-Elite Brewer", 20, "75.00", "169.99", 250),
    ("Nespresso Pods 50ct", 20, "22.00", "49.99", 1500),
    ("Starbucks Ground Coffee 2lb", 20, "14.00", "29.99", 2000),
    ('iPad Pro 12.9"', 7, "720.00", "1099.99", 200),
    ('Dell 27" 4K Monitor', 8, "280.00", "549.99", 180),
    ("Logitech MX Keys Keyboard", 9, "55.00", "109.99", 600),
    ("Anker 65W USB-C Charger", 9, "18.00", "39.99", 1800),
    ("GoPro HERO12 Black", 7, "220.00", "399.99", 250),
    ("Ring Video Doorbell Pro", 10, "130.00", "249.99", 300),
    ("Echo Dot 5th Gen", 9, "28.00", "49.99", 2000),
    ("Fire TV Stick 4K Max", 9, "30.00", "59.99", 1500),
    ("Kindle Paperwhite", 8, "80.00", "139.99", 700),
    ("Nintendo Switch OLED", 7, "250.00", "349.99", 400),
)

# Names given to generated customers.
FIRST_NAMES = (
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda",
    "William", "Barbara", "David", "Susan", "Richard", "Jessica", "Joseph", "Sarah",
    "Thomas", "Karen", "Charles", "Lisa", "Christopher", "Nancy", "Daniel", "Betty",
    "Matthew", "Margaret", "Anthony", "Sandra", "Mark", "Ashley",
)
LAST_NAMES = (
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis",
    "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson",
    "Thomas", "Taylor", "Moore", "Jackson", "Martin", "Lee", "Perez", "Thompson",
    "White", "Harris", "Sanchez", "Clark", "Ramirez", "Lewis", "Robinson",
)

# Contact data of generated customers, around their number.
EMAIL_PARTS = ("customer", "@retaildemo.com")
PHONE_PREFIX = "555-"

# Order states and payment methods, both picked by the same remainder.
STATUS_CYCLE = (
    "Delivered", "Delivered", "Delivered", "Shipped", "Processing", "Cancelled", "Returned",
)
PAYMENT_CYCLE = (
    "Credit Card", "Credit Card", "PayPal", "Debit Card", "Bank Transfer", "Apple Pay",
    "Google Pay",
)


def _literal(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    """Rows held in the plan itself: Spark knows their size and broadcasts them in joins."""
    schema = SCHEMAS[table]
    columns = dict(zip(schema.names, map(list, zip(*rows))))
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(schema)), schema)


def gen_regions(spark: SparkSession) -> DataFrame:
    rows = [(i, name, DEFAULT_COUNTRY) for i, name in enumerate(REGIONS, 1)]
    return _literal(spark, "regions", rows)


def gen_categories(spark: SparkSession) -> DataFrame:
    rows = [(i, *category) for i, category in enumerate(CATEGORIES, 1)]
    return _literal(spark, "categories", rows)


def gen_products(spark: SparkSession) -> DataFrame:
    rows = [
        (i, name, category, Decimal(cost), Decimal(price), stock, True)
        for i, (name, category, cost, price, stock) in enumerate(PRODUCTS, 1)
    ]
    return _literal(spark, "products", rows)
