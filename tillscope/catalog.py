"""All operators over a model, by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from tillscope.model import RetailModel
from tillscope.operators import (
    counts,
    customers,
    dashboard,
    hierarchy,
    insights,
    joins,
    products,
    quality,
    quarantine,
    subqueries,
    trends,
)

_FUNCTIONS = (
    joins.a1_order_details,
    joins.a2_customers_without_orders,
    joins.a3_segment_revenue,
    subqueries.b1_above_average_customers,
    subqueries.b2_category_revenue_share,
    subqueries.b3_active_categories,
    trends.c1_monthly_trend,
    hierarchy.c2_category_tree,
    customers.c3_customer_lifetime_value,
    products.d1_top_products_by_region,
    trends.d2_month_over_month,
    trends.d3_region_running_total,
    customers.d4_spend_quartiles,
    customers.e1_top_customers_correlated,
    customers.e1_top_customers_preagg,
    trends.e2_monthly_gross,
    trends.e2_monthly_gross_preproject,
    products.f1_product_margin,
    customers.f2_cohort_retention,
    products.f3_underperforming_categories,
    dashboard.va1_order_listing,
    dashboard.va3_segment_revenue_all,
    dashboard.vc1_running_total,
    customers.vc3_clv_ntile,
    dashboard.vd1_top_products,
    dashboard.vd2_growth_direction,
    dashboard.ve1_top_customers_nulls_first,
    dashboard.ve1_top_customers_unrounded,
    dashboard.vst_stat_strip,
    insights.i1_top_products,
    insights.i2_region_year,
    insights.i3_segment_profile,
    insights.i4_quartile_share,
    insights.i5_quarter_growth,
    insights.i6_peak_trough_month,
    insights.i7_leaf_underperformers,
    insights.i8_segment_uplift,
    counts.g7_row_counts,
    quality.q_pk,
    quality.q_uniq,
    quality.q_fk,
    quality.q_check,
    quality.q_nn,
    quality.q_def,
    quarantine.q_violations,
    quarantine.q_scan,
)

OPERATORS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in _FUNCTIONS}


def run(model: RetailModel, name: str, **parameters) -> DataFrame:
    """Run an operator; parameters that only other operators have are left out.

    So a list of operators can be run with one set of parameters, such as
    ``as_of`` and ``ordered``. A parameter that no operator has is an error.
    """
    operator = OPERATORS[name]
    unknown = set(parameters) - {
        key for function in _FUNCTIONS for key in inspect.signature(function).parameters
    }
    if unknown:
        raise TypeError(f"no operator has the parameters {sorted(unknown)}")
    known = inspect.signature(operator).parameters
    return operator(model, **{key: value for key, value in parameters.items() if key in known})
