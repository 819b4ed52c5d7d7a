"""The named questions of the SQL explorer, and free SQL over the sales table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.operators import aggregates as agg

EXAMPLE_QUERY = """
    select category, season, count(distinct product_id) as products, sum(quantity_sold) as units
    from sales where quantity_sold > 0 group by category, season"""


def _by_mean(sales: DataFrame, fastest: bool) -> DataFrame:
    order = F.desc("avg_daily_demand") if fastest else F.asc("avg_daily_demand")
    return (
        sales.groupBy("product_name", "category")
        .agg(agg.mean_units("avg_daily_demand"), agg.units("total_sold"))
        .orderBy(order, "product_name")
        .limit(5)
    )


def top10_products(sales: DataFrame) -> DataFrame:
    """By name alone: a name sold in two categories is one line."""
    return (
        sales.groupBy("product_name").agg(agg.units("total_sold"), agg.mean_units())
        .orderBy(F.desc("total_sold"), "product_name").limit(10)
    )


def monthly_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy(agg.month_of().alias("month")).agg(agg.units("total_sales"), agg.revenue()).orderBy("month")


def seasonal_category(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy("season", "category")
        .agg(agg.units("total_demand"), agg.mean_units())
        .orderBy("season", F.desc("total_demand"), "category")
    )


def season_revenue(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy("season")
        .agg(agg.revenue(), F.round(F.avg("revenue"), 2).alias("avg_daily_revenue"), agg.units("total_units"))
        .orderBy(F.desc("total_revenue"))
    )


def expiry_risk(sales: DataFrame) -> DataFrame:
    return (
        sales.filter("expiry_risk = 1")
        .groupBy("product_name", "category")
        .agg(F.sum("expiry_risk").alias("expiry_risk_days"), F.round(F.avg("current_stock"), 0).alias("avg_stock"))
        .orderBy(F.desc("expiry_risk_days"), "product_name")
    )


def festival_demand(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy("product_name", "is_festival_month")
        .agg(agg.mean_units("avg_daily_demand"))
        .orderBy("product_name", "is_festival_month")
    )


#: By the names of the registered queries.
PRESETS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "preset_top10_products": top10_products,
    "preset_monthly_trend": monthly_sales,
    "preset_seasonal_category": seasonal_category,
    "preset_slow_bottom5": lambda sales: _by_mean(sales, fastest=False),
    "preset_fast_top5": lambda sales: _by_mean(sales, fastest=True),
    "preset_season_revenue": season_revenue,
    "expiry_risk_products": expiry_risk,
    "preset_festival_vs_normal": festival_demand,
    "preset_yoy": agg.yearly_totals,
    "low_stock_days": agg.low_stock_days,
}


def run_preset(sales: DataFrame, name: str) -> DataFrame:
    return PRESETS[name](sales)


def run_sql(sales: DataFrame, text: str, **params) -> DataFrame:
    """Run a SELECT over ``sales``; values for ``:name`` markers come as keyword arguments.

    The text runs as a subquery, where Spark's grammar allows queries only: commands that
    change tables or settings do not parse.
    """
    spark: SparkSession = sales.sparkSession
    view = f"sales_{uuid.uuid4().hex}"
    sales.createOrReplaceTempView(view)
    try:
        return spark.sql(f"with sales as (select * from {view}) select * from (\n{text.strip().rstrip(';')}\n)", args=params or None)
    finally:
        spark.catalog.dropTempView(view)  # the plan is resolved by now
