"""Store overview: the stock table of all products and its key figures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from stockloom import rules
from stockloom.functions import stock_rules
from stockloom.functions.numeric import half_even
from stockloom.operators import stock
from stockloom.operators.features import last_rows


def stock_status_table(
    sales: DataFrame,
    catalog: DataFrame,
    inventory: DataFrame,
    as_of: date | str | None = None,
    horizon: int = 30,
    fast: float = rules.FAST_UNITS,
    slow: float = rules.SLOW_UNITS,
) -> DataFrame:
    """Forecast, recommendation, stock, turnover class and alert status of every product."""
    recommended = stock.trend_recommendations(last_rows(sales, rules.WINDOW_ROWS), sales, catalog, as_of, horizon)
    return (
        stock.with_alert(stock.with_stock(recommended, inventory))
        .select(
            "product_id", "product_name", F.initcap("category").alias("category"), "avg_daily_demand",
            "predicted_demand", "safety_stock", "reorder_point", "recommended_stock", "current_stock",
            "buffer_pct", "seasonal_factor",
            stock_rules.turnover_class("avg_daily_demand", fast, slow).alias("turnover"),
            F.coalesce("label", F.lit(rules.HEALTHY_LABEL)).alias("status"),
            "alert_type", "severity",
        )
        .orderBy("product_id")
    )


def overview_kpis(table: DataFrame) -> DataFrame:
    """One row of counts over the stock table."""
    return table.agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("predicted_demand").alias("total_forecast"),
        F.count_if(F.col("severity").isin("critical", "warning")).alias("low_stock_alerts"),
        F.count_if(F.col("alert_type") == "OVERSTOCK").alias("overstock_alerts"),
        half_even(F.avg("seasonal_factor"), 2).alias("avg_seasonal_factor"),
    )


def business_kpis(table: DataFrame, inventory: DataFrame, horizon: int = 30) -> DataFrame:
    """Stock-out and overstock share, days of coverage and totals. All counted stock is included."""
    figures = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity").isin("critical", "warning")).alias("low"),
        F.count_if(F.col("alert_type") == "OVERSTOCK").alias("over"),
        F.sum("predicted_demand").alias("forecast"),
        F.sum("recommended_stock").alias("total_recommended"),
        F.avg("seasonal_factor").alias("factor"),
    )
    held = inventory.agg(F.coalesce(F.sum("current_stock"), F.lit(0)).alias("total_current"))
    products = F.nullif(F.col("n"), F.lit(0)).cast("double")
    return figures.crossJoin(F.broadcast(held)).select(  # one row each
        half_even(F.col("low") / products * 100, 1).alias("stockout_risk_pct"),
        half_even(F.col("over") / products * 100, 1).alias("overstock_pct"),
        half_even(
            F.col("total_current").cast("double") / F.greatest(F.lit(1), F.col("forecast")) * horizon, 1
        ).alias("coverage_days"),
        "total_recommended", "total_current",
        half_even(F.col("factor"), 2).alias("avg_seasonal_factor"),
    )
