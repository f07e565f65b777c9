"""DuckDB SQL for every registered query, written apart from the Spark code.

All amounts are integers here: cents, or 1/10000 for amounts after the line
discount. Every rounding is therefore exact integer arithmetic, half away from
zero, and no intermediate result is a double.
"""

from __future__ import annotations

from tillscope.sources.catalogue import (
    FIRST_NAMES,
    LAST_NAMES,
    PAYMENT_CYCLE,
    PRODUCTS,
    STATUS_CYCLE,
)

AS_OF = "DATE '2001-08-02'"
SINCE = "DATE '2000-08-02'"


def rounded(top: str, bottom: str, scale: int, per: int = 1) -> str:
    """top / bottom * per rounded to ``scale`` decimals, as DOUBLE; NULL if bottom is 0."""
    unit = 10**scale
    whole = f"(2 * ABS(CAST({top} AS HUGEINT)) * {per * unit} + ({bottom})) // (2 * ({bottom}))"
    return (
        f"CASE WHEN ({bottom}) = 0 THEN NULL "
        f"ELSE CAST(SIGN({top}) * ({whole}) AS DOUBLE) / {unit} END"
    )


def money(units: str) -> str:
    """1/10000 units to money with two decimals."""
    return rounded(units, "CAST(10000 AS HUGEINT)", 2)


def cents(units: str) -> str:
    """1/10000 units to whole cents (amounts here are never negative)."""
    return f"((({units}) + 50) // 100)"


def as_money(cent_amount: str) -> str:
    return f"(CAST({cent_amount} AS DOUBLE) / 100)"


BASE = """
WITH sale_line AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
         CAST(l_quantity AS BIGINT) AS qty,
         CAST(ROUND(l_discount * 100) AS BIGINT) AS pct,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS gross_c,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT)
           * (100 - CAST(ROUND(l_discount * 100) AS BIGINT)) AS net_u
  FROM lineitem),
header AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS sales_month,
         o_orderpriority AS payment_method,
         CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Shipped'
              WHEN 'P' THEN 'Cancelled' ELSE o_orderstatus END AS status
  FROM orders),
good_header AS (SELECT * FROM header WHERE status <> 'Cancelled'),
cust AS (
  SELECT c_custkey AS customer_id, replace(c_name, '#', ' ') AS customer_name,
         split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
         'customer' || c_custkey || '@example.com' AS email, c_mktsegment AS segment,
         CAST(n_regionkey AS BIGINT) AS region_id, r_name AS region_name,
         DATE '1995-01-01' + CAST(c_custkey % 1826 AS INT) AS date_joined,
         c_acctbal >= 0 AS is_active
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
cat AS (
  SELECT DISTINCT p_type AS category_id, p_type AS category_name,
         CAST(NULL AS VARCHAR) AS parent_id, p_type <> 'PROMO' AS is_active FROM part
  UNION ALL
  SELECT DISTINCT p_type || '/' || p_brand, p_brand, p_type, TRUE FROM part),
prod AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS root_name,
         p_type || '/' || p_brand AS category_id, p_brand AS category_name,
         CAST(ROUND(p_retailprice * 100) AS BIGINT) AS price_c,
         (CAST(ROUND(p_retailprice * 100) AS BIGINT) * (500 + 5 * p_size) + 500) // 1000 AS cost_c,
         p_size >= 5 AS is_active
  FROM part),
sold AS (
  SELECT sale_line.*, customer_id, order_date, sales_month
  FROM sale_line JOIN good_header USING (order_id)),
spend AS (
  SELECT customer_id, COUNT(DISTINCT order_id) AS orders, SUM(net_u) AS net_u
  FROM sold GROUP BY customer_id),
delivered AS (
  SELECT customer_id, SUM(gross_c) AS gross_c
  FROM sale_line JOIN header USING (order_id) WHERE status = 'Delivered' GROUP BY customer_id),
months AS (
  SELECT sales_month, SUM(net_u) AS net_u, COUNT(DISTINCT order_id) AS orders,
         COUNT(DISTINCT customer_id) AS buyers
  FROM sold GROUP BY sales_month),
region_months AS (
  SELECT region_name, sales_month, SUM(net_u) AS net_u
  FROM sold JOIN cust USING (customer_id) GROUP BY ALL),
history AS (
  SELECT customer_id, COUNT(*) AS orders, MIN(order_date) AS first_date, MAX(order_date) AS last_date
  FROM good_header GROUP BY customer_id)
"""

_SEGMENT = """
SELECT segment, COUNT(DISTINCT customer_id) AS total_customers,
       COUNT(DISTINCT order_id) AS total_orders, {columns}
FROM sale_line JOIN {headers} USING (order_id) JOIN cust USING (customer_id)
GROUP BY segment"""

_QUARTILES = """, quartiles AS (
  SELECT customer_id, {cents} AS spend_c,
         NTILE(4) OVER (ORDER BY {cents}, customer_id) AS spend_quartile
  FROM spend)""".format(cents=cents("net_u"))

_CLV = f""", clv_parts AS (
  SELECT customer_id, {cents("net_u")} AS spend_c, history.orders AS orders,
         spend.orders AS sold_orders, net_u,
         (2 * CAST(net_u AS HUGEINT) + 100 * history.orders) // (200 * history.orders) AS aov_c,
         date_diff('day', first_date, last_date) AS span,
         date_diff('day', last_date, {AS_OF}) AS recency
  FROM spend JOIN history USING (customer_id)),
clv AS (
  SELECT *, CASE WHEN span > 0 THEN
           (2 * 36500 * ((2 * CAST(orders AS HUGEINT) * 100000000000000000000 + span) // (2 * span))
            + 100000000000000000000) // 200000000000000000000 END AS rate_c
  FROM clv_parts),
scored AS (
  SELECT *, (CAST(aov_c AS HUGEINT) * rate_c * 3 + 50) // 100 AS clv_c FROM clv)"""

_GROWTH = f""", month_cents AS (SELECT sales_month, {cents("net_u")} AS c FROM months),
growth AS (
  SELECT sales_month, c, LAG(c) OVER w AS before_c, LEAD(c) OVER w AS after_c,
         SUM(c) OVER w3 AS recent, COUNT(*) OVER w3 AS recent_rows
  FROM month_cents
  WINDOW w AS (ORDER BY sales_month),
         w3 AS (ORDER BY sales_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""

_TOP_PRODUCTS = f""", region_products AS (
  SELECT region_name, product_id, {cents("SUM(net_u)")} AS c
  FROM sold JOIN cust USING (customer_id) GROUP BY region_name, product_id),
ranked AS (
  SELECT *, DENSE_RANK() OVER (PARTITION BY region_name ORDER BY c DESC) AS region_rank
  FROM region_products)"""

_ROOTS = f""", roots AS (
  SELECT root_name, SUM(qty) AS units, SUM(net_u) AS net_u, {cents("SUM(net_u)")} AS c,
         COUNT(DISTINCT order_id) AS orders
  FROM sold JOIN prod USING (product_id) GROUP BY root_name)"""


def _margins(lines: str) -> str:
    return f""", folded AS (
  SELECT product_id, SUM(qty) AS units, SUM(gross_c) AS gross_c FROM {lines} GROUP BY product_id),
profits AS (
  SELECT prod.*, units, gross_c - units * cost_c AS profit_c
  FROM prod LEFT JOIN folded USING (product_id))
SELECT product_id, product_name, category_name, {as_money("cost_c")} AS unit_cost,
       {as_money("price_c")} AS unit_price,
       {rounded("price_c - cost_c", "price_c", 1, 100)} AS margin_pct,
       CAST(units AS BIGINT) AS units_sold, {as_money("profit_c")} AS gross_profit,
       RANK() OVER (ORDER BY profit_c DESC NULLS FIRST) AS profit_rank
FROM profits"""


def _weak_roots(averaged: str) -> str:
    return f"""{_ROOTS},
whole AS (SELECT SUM(c) AS total, COUNT(*) AS n FROM roots),
low AS (SELECT roots.* FROM roots, whole WHERE c * n < total),
shown AS (SELECT SUM(c) AS total, COUNT(*) AS n FROM {averaged})
SELECT root_name AS category_name, {as_money("c")} AS net_revenue, orders AS order_count,
       {rounded("total", "100 * n", 2)} AS avg_category_revenue,
       {rounded("c * n - total", "100 * n", 2)} AS vs_average,
       {rounded("c * n - total", "total", 1, 100)} AS pct_vs_average
FROM low, shown"""


_DETAIL = f"""
SELECT order_id, order_date, status, customer_id, customer_name, segment AS customer_segment,
       region_name, product_id, product_name, category_name, qty AS quantity,
       {rounded("gross_c", "100 * qty", 2)} AS unit_price, CAST(pct AS DOUBLE) AS discount_pct,
       {as_money("gross_c")} AS gross_revenue, {money("net_u")} AS net_revenue
FROM sale_line JOIN good_header USING (order_id) JOIN cust USING (customer_id)
JOIN prod USING (product_id)"""

_DORMANT = f"""
SELECT customer_id, customer_name, email, segment, region_name, date_joined,
       date_diff('day', date_joined, {AS_OF}) AS days_since_joined
FROM cust WHERE is_active AND customer_id NOT IN ({{buyers}})"""

_DELIVERED_MONTHS = f"""
SELECT sales_month, {as_money("SUM(gross_c)")} AS gross_revenue
FROM sale_line JOIN header USING (order_id) WHERE status = 'Delivered' GROUP BY sales_month"""

_TREND = f"""
SELECT sales_month, {money("net_u")} AS net_revenue, orders AS order_count,
       buyers AS unique_customers, {rounded("net_u", "10000 * orders", 2)} AS avg_order_value,
       {money("SUM(net_u) OVER (ORDER BY sales_month)")} AS cumulative_revenue
FROM months"""


def _growth_columns(scale: int) -> str:
    return rounded("c - before_c", "before_c", scale, 100)


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


_GENERATED_CUSTOMERS = f"""
SELECT c_custkey + 1 AS customer_id,
       {_list(FIRST_NAMES)}[c_custkey % 30 + 1] AS first_name,
       {_list(LAST_NAMES)}[c_custkey % 30 + 1] AS last_name,
       'customer' || (c_custkey + 1) || '@retaildemo.com' AS email,
       '555-' || printf('%04d', (c_custkey + 1) % 10000) AS phone,
       (c_custkey + 1) % 6 + 1 AS region_id,
       {{segment}} AS segment,
       DATE '2019-01-01' + CAST((c_custkey + 1) % 1826 AS INT) AS date_joined,
       (c_custkey + 1) % 25 > 0 AS is_active
FROM customer"""

_BASE_SEGMENT = """['Bronze', 'Bronze', 'Bronze', 'Bronze', 'Bronze',
        'Silver', 'Silver', 'Silver', 'Gold', 'Gold'][(c_custkey + 1) % 10 + 1]"""

_GENERATED_ORDERS = f"""
SELECT n AS order_id, n % 2000 + 1 AS customer_id,
       DATE '2020-01-01' + CAST(n % 1460 AS INT) AS order_date,
       CASE WHEN n % 7 > 0 THEN DATE '2020-01-01' + CAST(n % 1460 + n % 5 + 1 AS INT) END
         AS shipped_date,
       {_list(STATUS_CYCLE)}[n % 7 + 1] AS status,
       {_list(PAYMENT_CYCLE)}[n % 7 + 1] AS payment_method,
       [10.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0][n % 8 + 1]::DOUBLE AS discount_pct
FROM (SELECT o_orderkey + 1 AS n FROM orders)"""

_PRICE_LIST = "[" + ", ".join(price.replace(".", "") for _, _, _, price, _ in PRODUCTS) + "]"

_GENERATED_ITEMS = f"""
SELECT (n - 1) * 4 + line AS order_item_id, n AS order_id, slot AS product_id,
       (n + line) % 4 + 1 AS quantity,
       CAST(({_PRICE_LIST}[slot] * (100 - pct) + 50) // 100 AS DOUBLE) / 100 AS unit_price,
       CAST(pct AS DOUBLE) AS discount_pct
FROM (SELECT *, (n * 1009 + line * 7) % 80 + 1 AS slot,
             [10, 5, 0, 0, 0, 0, 0, 0][n % 8 + 1] AS pct
      FROM (SELECT o_orderkey + 1 AS n, UNNEST(range(1, 5 - (o_orderkey + 1) % 4)) AS line
            FROM orders))
WHERE slot <= 77"""


def _key_check(table: str, column: str, source: str, nulls: bool = True) -> str:
    null_rows = "CAST(SUM(CASE WHEN k IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_rows," if nulls else ""
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {null_rows}
  COUNT(CASE WHEN k IS NOT NULL AND n > 1 THEN 1 END) AS duplicate_keys,
  CAST(COALESCE(SUM(CASE WHEN k IS NOT NULL THEN n - 1 END), 0) AS BIGINT) AS surplus_rows
  FROM (SELECT k, COUNT(*) AS n FROM ({source}) GROUP BY k)"""


_KEYS = (
    ("regions", "region_id", "SELECT r_regionkey AS k FROM region"),
    ("categories", "category_id", "SELECT category_id AS k FROM cat"),
    ("customers", "customer_id", "SELECT customer_id AS k FROM cust"),
    ("products", "product_id", "SELECT product_id AS k FROM prod"),
    ("orders", "order_id", "SELECT order_id AS k FROM header"),
    ("order_items", "order_item_id", "SELECT order_id || '-' || line_no AS k FROM sale_line"),
)
_UNIQUE = (
    ("regions", "region_name", "SELECT r_name AS k FROM region"),
    ("customers", "email", "SELECT email AS k FROM cust"),
)
_REFERENCES = (
    ("categories", "parent_id", "categories", "SELECT parent_id AS k FROM cat",
     "SELECT category_id FROM cat"),
    ("customers", "region_id", "regions", "SELECT region_id AS k FROM cust",
     "SELECT r_regionkey FROM region"),
    ("products", "category_id", "categories", "SELECT category_id AS k FROM prod",
     "SELECT category_id FROM cat"),
    ("orders", "customer_id", "customers", "SELECT customer_id AS k FROM header",
     "SELECT customer_id FROM cust"),
    ("order_items", "order_id", "orders", "SELECT order_id AS k FROM sale_line",
     "SELECT order_id FROM header"),
    ("order_items", "product_id", "products", "SELECT product_id AS k FROM sale_line",
     "SELECT product_id FROM prod"),
)


def _reference_check(child: str, column: str, parent: str, source: str, targets: str) -> str:
    return f"""SELECT '{child}' AS table_name, '{column}' AS column_name,
  '{parent}' AS parent_table, COUNT(DISTINCT k) AS orphan_keys, COUNT(*) AS orphan_rows
  FROM ({source}) WHERE k IS NOT NULL AND k NOT IN ({targets})"""


# table -> its source and, per NOT NULL column, the source expression
_REQUIRED = {
    "regions": ("region", {
        "region_id": "r_regionkey", "region_name": "r_name", "country": "'United States'"}),
    "categories": ("cat", {
        "category_id": "category_id", "category_name": "category_name",
        "is_active": "is_active"}),
    "customers": ("cust", {
        "customer_id": "customer_id", "first_name": "first_name", "last_name": "last_name",
        "email": "email", "region_id": "region_id", "segment": "segment",
        "date_joined": "date_joined", "is_active": "is_active"}),
    "products": ("prod", {
        "product_id": "product_id", "product_name": "product_name",
        "category_id": "category_id", "unit_cost": "cost_c", "unit_price": "price_c",
        "stock_qty": "0", "is_active": "is_active"}),
    "orders": ("header", {
        "order_id": "order_id", "customer_id": "customer_id", "order_date": "order_date",
        "status": "status", "payment_method": "payment_method", "discount_pct": "0"}),
    "order_items": ("sale_line", {
        "order_item_id": "order_id + line_no", "order_id": "order_id",
        "product_id": "product_id", "quantity": "qty", "unit_price": "gross_c / qty",
        "discount_pct": "pct"}),
}

_FILLED = (
    ("regions", "country", "SELECT COUNT(*) FROM region"),
    ("categories", "is_active", "SELECT COUNT(*) FROM cat WHERE parent_id IS NOT NULL"),
    ("customers", "is_active", "SELECT COUNT(*) FROM cust WHERE is_active IS NULL"),
    ("products", "stock_qty", "SELECT COUNT(*) FROM prod"),
    ("products", "is_active", "SELECT COUNT(*) FROM prod WHERE is_active IS NULL"),
    ("orders", "discount_pct", "SELECT COUNT(*) FROM header"),
    ("order_items", "discount_pct", "SELECT COUNT(*) FROM sale_line WHERE pct IS NULL"),
)

_TABLE_ROWS = (
    ("regions", "region"),
    ("categories", "cat"),
    ("customers", "cust"),
    ("products", "prod"),
    ("orders", "header"),
    ("order_items", "sale_line"),
)

_COUNTS = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS tbl, COUNT(*) AS rows FROM {source}" for name, source in _TABLE_ROWS
)


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# table -> its key as text, and (rule, condition) for repeated keys, references and checks
_FAULTS = {
    "regions": ("r_regionkey::VARCHAR", (
        ("region_id repeated", "r_regionkey IN (SELECT r_regionkey FROM region GROUP BY 1 HAVING COUNT(*) > 1)"),
        ("region_name repeated", "r_name IN (SELECT r_name FROM region GROUP BY 1 HAVING COUNT(*) > 1)"),
    ), ()),
    "categories": ("category_id", (
        ("category_id repeated", "category_id IN (SELECT category_id FROM cat GROUP BY 1 HAVING COUNT(*) > 1)"),
        ("parent_id not in categories", "parent_id NOT IN (SELECT category_id FROM cat)"),
    ), ()),
    "customers": ("customer_id::VARCHAR", (
        ("customer_id repeated", "customer_id IN (SELECT customer_id FROM cust GROUP BY 1 HAVING COUNT(*) > 1)"),
        ("email repeated", "email IN (SELECT email FROM cust GROUP BY 1 HAVING COUNT(*) > 1)"),
        ("region_id not in regions", "region_id NOT IN (SELECT r_regionkey FROM region)"),
    ), (
        ("segment in domain",
         "segment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"),
    )),
    "products": ("product_id::VARCHAR", (
        ("product_id repeated", "product_id IN (SELECT product_id FROM prod GROUP BY 1 HAVING COUNT(*) > 1)"),
        ("category_id not in categories", "category_id NOT IN (SELECT category_id FROM cat)"),
    ), ()),
    "orders": ("order_id::VARCHAR", (
        ("order_id repeated", "order_id IN (SELECT order_id FROM header GROUP BY 1 HAVING COUNT(*) > 1)"),
        ("customer_id not in customers", "customer_id NOT IN (SELECT customer_id FROM cust)"),
    ), (
        ("status in domain",
         "status NOT IN ('Pending', 'Processing', 'Shipped', 'Delivered', 'Cancelled', 'Returned')"),
    )),
    "order_items": ("(order_id::HUGEINT * 4294967296 + line_no)::VARCHAR", (
        ("order_item_id repeated",
         "(order_id, line_no) IN (SELECT (order_id, line_no) FROM sale_line GROUP BY 1 HAVING COUNT(*) > 1)"),
        ("order_id not in orders", "order_id NOT IN (SELECT order_id FROM header)"),
        ("product_id not in products", "product_id NOT IN (SELECT product_id FROM prod)"),
    ), (
        ("quantity positive", "qty <= 0"),
    )),
}


def _violations() -> str:
    parts = []
    for table, (key, between, checks) in _FAULTS.items():
        source, required = _REQUIRED[table]
        if table == "order_items":  # the altered rows keep their unit price, whatever their quantity
            required = required | {"unit_price": "gross_c"}
        nulls = [(f"{c} is NULL", f"({expression}) IS NULL") for c, expression in required.items()]
        rules = ", ".join(f"CASE WHEN {wrong} THEN '{rule}' END" for rule, wrong in (*between, *nulls, *checks))
        parts.append(
            f"SELECT '{table}' AS table_name, {key} AS row_key, concat_ws('; ', {rules}) AS rules FROM {source}"
        )
    return f"SELECT * FROM ({_union(parts)}) WHERE rules <> ''"


#: Views that take the place of others, with faults planted by the keys.
_ALTERED = """,
header_ AS (
  SELECT order_id, CASE WHEN order_id % 83 = 0 THEN -order_id ELSE customer_id END AS customer_id,
         CASE WHEN order_id % 89 = 0 THEN NULL ELSE order_date END AS order_date, payment_method,
         CASE WHEN order_id % 97 = 0 THEN 'Lost' ELSE status END AS status
  FROM header),
altered_header AS (
  SELECT * FROM header_ UNION ALL SELECT * FROM header_ WHERE order_id % 211 = 0),
altered_cust AS (
  SELECT * REPLACE (
    CASE WHEN customer_id % 31 = 0 THEN 'IRON' ELSE segment END AS segment,
    CASE WHEN customer_id % 29 = 0 THEN 'same@example.com' ELSE email END AS email)
  FROM cust),
altered_sale_line AS (
  SELECT * REPLACE (
    CASE WHEN order_id % 101 = 0 THEN 0 ELSE qty END AS qty,
    CASE WHEN order_id % 103 = 0 THEN NULL ELSE product_id END AS product_id)
  FROM sale_line)
"""


def _altered(body: str) -> str:
    for view in ("header", "cust", "sale_line"):
        body = body.replace(f"FROM {view}", f"FROM altered_{view}")
    return _ALTERED + body


def _scan() -> str:
    """Row counts, NULLs, values to fill in (the same, of the columns with a default), failed checks."""
    parts = [f"SELECT '{t}' AS table_name, 'rows' AS kind, '' AS name, COUNT(*) AS rows FROM {s}" for t, s in _TABLE_ROWS]
    for table, (source, columns) in _REQUIRED.items():
        filled = {c for t, c, _ in _FILLED if t == table}
        for column, expression in columns.items():
            for kind in ("null", "default") if column in filled else ("null",):
                parts.append(f"SELECT '{table}', '{kind}', '{column}', COUNT(*) FROM {source} WHERE ({expression}) IS NULL")
        for rule, wrong in _FAULTS[table][2]:
            parts.append(f"SELECT '{table}', 'check', '{rule}', COUNT(*) FROM {source} WHERE {wrong}")
    return _union(parts)


def sql() -> dict[str, str]:
    queries = {
        "a1_order_details": _DETAIL,
        "a2_customers_without_orders": _DORMANT.format(buyers="SELECT customer_id FROM header"),
        "a2_customers_without_orders_thinned": _DORMANT.format(
            buyers="SELECT customer_id FROM header WHERE customer_id % 7 <> 0"
        ),
        "a2_dormant_customers": _DORMANT.format(
            buyers=f"SELECT customer_id FROM good_header WHERE order_date >= {SINCE}"
        ),
        "a3_segment_revenue": _SEGMENT.format(
            headers="good_header",
            columns=f"{money('SUM(net_u)')} AS total_net_revenue, "
            f"{rounded('SUM(net_u)', '10000 * COUNT(*)', 2)} AS avg_line_revenue, "
            f"{rounded('SUM(net_u)', '10000 * COUNT(DISTINCT order_id)', 2)} AS avg_order_value",
        ),
        "b1_above_average_customers": f"""
SELECT customer_id, customer_name, segment, region_name, {money("net_u")} AS lifetime_spend
FROM spend JOIN cust USING (customer_id)
WHERE net_u * (SELECT COUNT(*) FROM spend) > (SELECT SUM(net_u) FROM spend)""",
        "b2_category_revenue_share": f"""{_ROOTS}
SELECT root_name AS category_name, CAST(units AS BIGINT) AS total_units_sold,
       {money("net_u")} AS total_net_revenue,
       {rounded("net_u", "10000 * units", 2)} AS avg_selling_price,
       {rounded("net_u", "(SELECT SUM(net_u) FROM roots)", 1, 100)} AS revenue_pct
FROM roots""",
        "b3_active_categories": f"""
SELECT category_id, category_name, is_active FROM cat
WHERE parent_id IS NULL AND is_active AND category_id IN (
  SELECT root_name FROM sold JOIN prod USING (product_id)
  WHERE prod.is_active AND order_date >= {SINCE})""",
        "c1_monthly_trend": _TREND,
        "c2_category_tree": """
SELECT category_id, CASE WHEN parent_id IS NULL THEN '' ELSE '    ' END || category_name
         AS indented_name,
       CAST(CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS depth,
       CASE WHEN parent_id IS NULL THEN category_name
            ELSE parent_id || ' > ' || category_name END AS full_path,
       is_active
FROM cat""",
        "c3_customer_lifetime_value": f"""{_CLV}
SELECT customer_id, customer_name, segment, {as_money("spend_c")} AS lifetime_spend,
       orders AS total_orders, {as_money("aov_c")} AS avg_order_value,
       {as_money("rate_c")} AS orders_per_year, recency AS days_since_last_order,
       {as_money("clv_c")} AS clv_3yr_estimate,
       CASE WHEN spend_c >= 150000000 AND recency <= 90 THEN 'Champions'
            WHEN spend_c >= 100000000 AND recency <= 180 THEN 'Loyal Customers'
            WHEN recency <= 90 THEN 'Recent Customers'
            WHEN recency BETWEEN 91 AND 365 THEN 'At Risk'
            ELSE 'Lost' END AS rfm_tier
FROM scored JOIN cust USING (customer_id)""",
        "d1_top_products_by_region": f"""{_TOP_PRODUCTS}
SELECT region_name, region_rank, product_name, category_name, {as_money("c")} AS net_revenue
FROM ranked JOIN prod USING (product_id) WHERE region_rank <= 3""",
        "d2_month_over_month": f"""{_GROWTH}
SELECT sales_month, {as_money("c")} AS net_revenue, {as_money("before_c")} AS prev_month_revenue,
       {as_money("after_c")} AS next_month_revenue, {_growth_columns(2)} AS mom_growth_pct,
       {rounded("recent", "100 * recent_rows", 2)} AS rolling_3mo_avg
FROM growth""",
        "d3_region_running_total": f""",
region_cents AS (SELECT region_name, sales_month, {cents("net_u")} AS c FROM region_months),
running AS (
  SELECT *, SUM(c) OVER (PARTITION BY region_name ORDER BY sales_month) AS so_far,
         SUM(c) OVER (PARTITION BY region_name) AS total FROM region_cents)
SELECT region_name, sales_month, {as_money("c")} AS net_revenue,
       {as_money("so_far")} AS running_total,
       {rounded("c", "total", 1, 100)} AS pct_of_region_total
FROM running""",
        "d4_spend_quartiles": f"""{_QUARTILES}
SELECT customer_id, customer_name, segment AS crm_segment, region_name,
       {as_money("spend_c")} AS total_spend, spend_quartile,
       CASE spend_quartile WHEN 1 THEN 'Low Spender    (Q1)' WHEN 2 THEN 'Mid Spender    (Q2)'
            WHEN 3 THEN 'High Spender   (Q3)' ELSE 'Top Spender    (Q4)' END AS spend_tier
FROM quartiles JOIN cust USING (customer_id)""",
        "e1_top_customers_correlated": f"""
SELECT customer_id, customer_name, {as_money("gross_c")} AS total_spend
FROM cust LEFT JOIN delivered USING (customer_id)
ORDER BY gross_c DESC NULLS LAST, customer_id LIMIT 10""",
        "e1_top_customers_preagg": f"""
SELECT customer_id, customer_name, {as_money("gross_c")} AS total_spend
FROM cust JOIN delivered USING (customer_id) ORDER BY gross_c DESC, customer_id LIMIT 10""",
        "e2_monthly_gross": _DELIVERED_MONTHS,
        "e2_monthly_gross_preproject": _DELIVERED_MONTHS,
        "f1_product_margin": _margins("sale_line"),
        "f1_product_margin_valid_only": _margins("sold"),
        "f2_cohort_retention": """,
activity AS (
  SELECT DISTINCT customer_id, sales_month,
         CAST(date_trunc('month', first_date) AS DATE) AS cohort_month
  FROM good_header JOIN history USING (customer_id))
SELECT cohort_month, date_diff('month', cohort_month, sales_month) AS months_since_first_order,
       COUNT(DISTINCT customer_id) AS active_customers
FROM activity WHERE date_diff('month', cohort_month, sales_month) <= 11
GROUP BY ALL""",
        "f3_underperforming_categories": _weak_roots("low"),
        "f3_underperforming_overall_avg": _weak_roots("roots"),
        "va1_order_listing": f"""
SELECT order_id, customer_name, region_name, product_name, category_name, quantity, net_revenue
FROM ({_DETAIL})""",
        "va3_segment_revenue_all": _SEGMENT.format(
            headers="header",
            columns=f"{money('SUM(net_u)')} AS total_revenue, "
            f"{rounded('SUM(net_u)', '10000 * COUNT(DISTINCT order_id)', 2)} AS avg_order_value",
        ),
        "vc1_running_total": f"""
SELECT sales_month AS month, net_revenue AS monthly_revenue, cumulative_revenue AS running_total
FROM ({_TREND})""",
        "vc3_clv_ntile": f""",
value AS (
  SELECT customer_id, COUNT(DISTINCT order_id) AS orders, SUM(net_u) AS net_u
  FROM sale_line JOIN header USING (order_id) GROUP BY customer_id),
tiled AS (SELECT *, NTILE(4) OVER (ORDER BY net_u, customer_id) AS quartile FROM value)
SELECT customer_id, customer_name AS customer, CAST(net_u AS DOUBLE) / 10000 AS lifetime_value,
       orders, CAST(net_u AS DOUBLE) / 10000 / orders AS avg_order,
       CASE quartile WHEN 4 THEN 'High Value' WHEN 3 THEN 'Medium' ELSE 'Low Value' END
         AS clv_segment
FROM tiled JOIN cust USING (customer_id) ORDER BY net_u DESC, customer_id LIMIT 10""",
        "vd1_top_products": f"""{_TOP_PRODUCTS}
SELECT region_name, product_name, {as_money("c")} AS net_revenue, region_rank AS rank_in_region
FROM ranked JOIN prod USING (product_id) WHERE region_rank <= 3""",
        "vd2_growth_direction": f"""{_GROWTH}
SELECT sales_month AS month, {as_money("c")} AS net_revenue, {as_money("before_c")}
         AS prev_month_rev, {_growth_columns(1)} AS mom_growth_pct,
       CASE WHEN ({_growth_columns(1)}) > 0 THEN '▲' WHEN ({_growth_columns(1)}) < 0 THEN '▼'
            WHEN ({_growth_columns(1)}) = 0 THEN '→' END AS direction
FROM growth""",
        "ve1_top_customers_nulls_first": f"""
SELECT customer_id, first_name, {as_money("gross_c")} AS total_spend
FROM cust LEFT JOIN delivered USING (customer_id)
ORDER BY gross_c DESC NULLS FIRST, customer_id LIMIT 10""",
        "ve1_top_customers_unrounded": f"""
SELECT customer_id, first_name, {as_money("gross_c")} AS total_spend
FROM cust JOIN delivered USING (customer_id) ORDER BY gross_c DESC, customer_id LIMIT 10""",
        "vst_stat_strip": f"""
SELECT CAST(SUM(rows) AS BIGINT) AS total_rows, COUNT(*) AS tables FROM ({_COUNTS})""",
        "i1_top_products": f""",
best AS (
  SELECT product_id, SUM(qty) AS units, SUM(net_u) AS net_u FROM sold GROUP BY product_id
  ORDER BY net_u DESC, product_id LIMIT 5)
SELECT product_id, product_name, category_name, CAST(units AS BIGINT) AS units_sold,
       {money("net_u")} AS net_revenue,
       {rounded("price_c - cost_c", "price_c", 1, 100)} AS margin_pct
FROM best JOIN prod USING (product_id)""",
        "i2_region_year": f""",
years AS (
  SELECT region_name, year(sales_month) AS sales_year, {cents("SUM(net_u)")} AS c
  FROM region_months GROUP BY ALL),
compared AS (
  SELECT *, SUM(c) OVER (PARTITION BY sales_year) AS year_c,
         LAG(c) OVER (PARTITION BY region_name ORDER BY sales_year) AS before_c FROM years)
SELECT region_name, sales_year, {as_money("c")} AS net_revenue,
       {rounded("c", "year_c", 1, 100)} AS pct_of_year, {_growth_columns(1)} AS yoy_pct
FROM compared""",
        "i3_segment_profile": f"""{_CLV},
profile AS (
  SELECT segment, COUNT(*) AS customers, COALESCE(SUM(net_u), 0) AS net_u,
         SUM(sold_orders) AS orders, SUM(clv_c) AS clv_c, COUNT(clv_c) AS estimates
  FROM cust LEFT JOIN scored USING (customer_id) GROUP BY segment)
SELECT segment, customers,
       {rounded("customers", "(SELECT SUM(customers) FROM profile)", 1, 100)} AS pct_of_base,
       {money("net_u")} AS total_net_revenue,
       {rounded("net_u", "(SELECT SUM(net_u) FROM profile)", 1, 100)} AS revenue_pct,
       {rounded("net_u", "10000 * orders", 2)} AS avg_order_value,
       {rounded("clv_c", "100 * estimates", 2)} AS avg_clv_3yr
FROM profile""",
        "i4_quartile_share": f"""{_QUARTILES}
SELECT spend_quartile, COUNT(*) AS customers, {as_money("SUM(spend_c)")} AS total_spend,
       {rounded("SUM(spend_c)", "(SELECT SUM(spend_c) FROM quartiles)", 1, 100)} AS revenue_pct
FROM quartiles GROUP BY spend_quartile""",
        "i5_quarter_growth": f"""{_GROWTH},
steps AS (
  SELECT quarter(sales_month) AS quarter,
         CAST(ROUND({_growth_columns(2)} * 100) AS HUGEINT) AS pct_c
  FROM growth WHERE before_c IS NOT NULL)
SELECT quarter, COUNT(*) AS months, {rounded("SUM(pct_c)", "100 * COUNT(*)", 2)}
         AS avg_mom_growth_pct
FROM steps GROUP BY quarter""",
        "i6_peak_trough_month": f"""{_GROWTH},
placed AS (
  SELECT year(sales_month) AS sales_year, sales_month, c,
         RANK() OVER (PARTITION BY year(sales_month) ORDER BY c DESC) AS from_top,
         RANK() OVER (PARTITION BY year(sales_month) ORDER BY c) AS from_bottom
  FROM month_cents)
SELECT sales_year, sales_month, {as_money("c")} AS net_revenue, from_top = 1 AS is_peak,
       from_bottom = 1 AS is_trough
FROM placed WHERE from_top = 1 OR from_bottom = 1""",
        "i7_leaf_underperformers": f""",
leaf AS (
  SELECT category_id, category_name, is_active,
         {cents("(SELECT COALESCE(SUM(net_u), 0) FROM sold JOIN prod USING (product_id) WHERE prod.category_id = cat.category_id)")} AS c
  FROM cat WHERE category_id NOT IN (SELECT parent_id FROM cat WHERE parent_id IS NOT NULL)),
whole AS (SELECT SUM(c) AS total, COUNT(*) AS n FROM leaf)
SELECT category_id, category_name, is_active, {as_money("c")} AS net_revenue,
       {rounded("total", "100 * n", 2)} AS category_average,
       {rounded("c * n - total", "total", 1, 100)} AS gap_pct
FROM leaf, whole WHERE c * n < total""",
        "i8_segment_uplift": f""",
means AS (
  SELECT segment, COUNT(*) AS customers,
         (2 * CAST(SUM(net_u) AS HUGEINT) + 100 * COUNT(*)) // (200 * COUNT(*)) AS mean_c
  FROM cust LEFT JOIN spend USING (customer_id) GROUP BY segment)
SELECT s.segment AS source_segment, t.segment AS target_segment, s.customers AS source_customers,
       {as_money("s.mean_c")} AS source_revenue_per_customer,
       {as_money("t.mean_c")} AS target_revenue_per_customer,
       {rounded("10 * s.customers * (t.mean_c - s.mean_c)", "CAST(10000 AS HUGEINT)", 2)}
         AS revenue_uplift
FROM means s, means t WHERE s.segment = 'BUILDING' AND t.segment = 'MACHINERY'""",
        "g7_row_counts": f"""
SELECT * FROM ({_COUNTS})
UNION ALL SELECT '--- TOTAL ---', CAST(SUM(rows) AS BIGINT) FROM ({_COUNTS})""",
        "g8_adapt_regions": """SELECT CAST(r_regionkey AS BIGINT) AS region_id,
       r_name AS region_name, 'United States' AS country FROM region""",
        "g8_adapt_categories": "SELECT * FROM cat",
        "g8_adapt_customers": """
SELECT customer_id, first_name, last_name, email, CAST(NULL AS VARCHAR) AS phone, region_id,
       segment, date_joined, is_active FROM cust""",
        "g8_adapt_products": f"""
SELECT product_id, product_name, category_id, {as_money("cost_c")} AS unit_cost,
       {as_money("price_c")} AS unit_price, CAST(0 AS BIGINT) AS stock_qty, is_active FROM prod""",
        "g8_adapt_orders": """
SELECT order_id, customer_id, order_date, CAST(NULL AS DATE) AS shipped_date, status,
       payment_method, CAST(0 AS DOUBLE) AS discount_pct FROM header""",
        "g8_adapt_order_items": f"""
SELECT CAST(CAST(order_id AS HUGEINT) * 4294967296 + line_no AS DOUBLE) AS order_item_id, order_id, product_id, qty AS quantity,
       {rounded("gross_c", "100 * qty", 2)} AS unit_price, CAST(pct AS DOUBLE) AS discount_pct,
       gross_c * 10000 AS gross_micros, net_u * 100 AS net_micros
FROM sale_line""",
        "q_pk": _union(_key_check(*key) for key in _KEYS),
        "q_uniq": _union(_key_check(*key, nulls=False) for key in _UNIQUE),
        "q_fk": _union(_reference_check(*reference) for reference in _REFERENCES),
        "q_check": """
SELECT 'customers' AS table_name, 'segment in domain' AS rule, COUNT(*) AS violations FROM cust
WHERE segment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')
UNION ALL SELECT 'orders', 'status in domain', COUNT(*) FROM header
WHERE status NOT IN ('Pending', 'Processing', 'Shipped', 'Delivered', 'Cancelled', 'Returned')
UNION ALL SELECT 'order_items', 'quantity positive', COUNT(*) FROM sale_line WHERE qty <= 0""",
        "q_nn": _union(
            f"SELECT '{table}' AS table_name, '{column}' AS column_name, COUNT(*) AS null_rows "
            f"FROM {source} WHERE ({expression}) IS NULL"
            for table, (source, columns) in _REQUIRED.items()
            for column, expression in columns.items()
        ),
        "q_def": _union(
            f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
            f"({count}) AS filled_rows"
            for table, column, count in _FILLED
        ),
    }
    queries |= {
        "q_violations": _violations(),
        "q_violations_altered": _altered(_violations()),
        "q_scan": _scan(),
    }
    text = {name: BASE + body for name, body in queries.items()}
    text["g4_gen_customers"] = _GENERATED_CUSTOMERS.format(segment=_BASE_SEGMENT)
    text["g4b_reclassify_platinum"] = _GENERATED_CUSTOMERS.format(
        segment=f"CASE WHEN (c_custkey + 1) % 20 = 0 THEN 'Platinum' ELSE {_BASE_SEGMENT} END"
    )
    text["g5_gen_orders"] = _GENERATED_ORDERS
    text["g6_gen_order_items"] = _GENERATED_ITEMS
    return text
