"""Forecast, alert and daily sales reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from stockloom import rules
from stockloom.functions import alerts as alert_rules
from stockloom.operators import stock
from stockloom.operators.aggregates import tail
from stockloom.operators.features import last_rows
from stockloom.sources.sales import with_revenue


def forecast_report(
    sales: DataFrame,
    catalog: DataFrame,
    inventory: DataFrame,
    as_of: date | str | None = None,
    horizon: int = 30,
) -> DataFrame:
    """One line per product."""
    recommended = stock.trend_recommendations(last_rows(sales, rules.WINDOW_ROWS), sales, catalog, as_of, horizon)
    return stock.with_stock(recommended, inventory).select(
        "product_id", "product_name", F.initcap("category").alias("category"), "unit_price",
        F.lit(horizon).alias("horizon_days"), F.col("predicted_demand").alias("forecast"),
        "avg_daily_demand", "safety_stock", "reorder_point", "recommended_stock", "buffer_pct",
        "seasonal_factor", "lead_time_days", "current_stock",
    ).orderBy("product_id")


def alerts_report(
    sales: DataFrame,
    catalog: DataFrame,
    inventory: DataFrame,
    as_of: date | str | None = None,
    horizon: int = 30,
) -> DataFrame:
    """The alerts, or one row saying that there are none. Nothing runs before the report is read."""
    recommended = stock.trend_recommendations(last_rows(sales, rules.WINDOW_ROWS), sales, catalog, as_of, horizon)
    listed = stock.unsorted_alerts(recommended, inventory).select(
        F.col("product_name").alias("product"), "alert_type", "severity", "current_stock", "recommended_stock",
        "reorder_point", F.coalesce("deficit", "excess").alias("deficit_or_excess"),
        F.lit(None).cast("string").alias("status"), "message", "product_id",
    )
    status, message = rules.NO_ALERTS
    line = sales.sparkSession.range(1).select(*[
        F.lit({"status": status, "message": message}.get(f.name)).cast(f.dataType).alias(f.name) for f in listed.schema
    ])
    first = listed.limit(1).select(F.lit(True).alias("_some"))  # at most one row
    healthy = line.join(F.broadcast(first), F.lit(True), "left_anti")
    return (
        listed.unionByName(healthy)
        .orderBy(alert_rules.severity_rank("severity"), "product_id")
        .drop("product_id")
    )


def daily_sales_report(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every row of the feature frame as a report line; the warm-up rows of a series are not part of it."""
    facts = catalog.select("product_id", F.col("product_name").alias("_name"), F.col("category").alias("_category"))
    return (
        with_revenue(features)
        .join(facts, "product_id", "left")
        .select(
            F.date_format("date", "yyyy-MM-dd").alias("date"),
            "product_id",
            F.coalesce("_name", "product_id").alias("product_name"),
            F.initcap("_category").alias("category"),
            "season", "quantity_sold",
            F.round("revenue", 2).alias("revenue"),
        )
    )


def daily_sales_tail(report: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` lines of the daily sales report, by product and date."""
    return tail(report, n, "product_id", "date")
